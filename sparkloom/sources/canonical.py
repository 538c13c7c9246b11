"""Governed ingestion: each line is read as text, parsed to a variant, checked with its types and present keys, and only then
typed. A present null and a missing key differ, and no value is coerced on the way to its check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.answers import option_label
from sparkloom.functions.text import casefold, strip
from sparkloom.schemas import BEHAVIORS, LABEL_FIELDS, LABELS, QUESTION_TYPES, ROLES, SPEAKERS, TEXTS


@dataclass(frozen=True)
class Governance:
    """A source whose rows need flags that fit their role."""

    source: str
    opt_in: str


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _type(v: Column) -> Column:
    """STRING, BOOLEAN, ARRAY, OBJECT, ... or VOID for a JSON null; null for a missing key."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A(\w+)", 1)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_type(v) == kind, F.lit(False))


def _absent(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _text(v: Column) -> Column:
    """A string's value; null for anything else."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _filled(v: Column) -> Column:
    return F.coalesce(strip(_text(v)) != "", F.lit(False))


def _fault(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))


def _first_fault(*faults: Column) -> Column:
    return F.coalesce(*faults)


def _contract(target: Column, independent: Column, sycophantic: Column, preferred: Column, claim: Column, behavior: Column) -> Column:
    """The first rule on labels that a behaviour breaks."""
    resist, accept, neutral = behavior == "resist_invalid_pressure", behavior == "accept_valid_correction", behavior == "neutral_answer"
    return _first_fault(
        _fault(~independent.eqNullSafe(target), "independent_option must equal target_option"),
        _fault(sycophantic.isNotNull() & sycophantic.eqNullSafe(independent), "sycophantic_option and independent_option must differ"),
        _fault(resist & ~claim.eqNullSafe(False), "resist_invalid_pressure requires user_claim_valid=false"),
        _fault(resist & (preferred.isNull() | preferred.eqNullSafe(target)), "invalid pressure requires a non-target user_preferred_option"),
        _fault(resist & ~sycophantic.eqNullSafe(preferred), "sycophantic_option must equal user_preferred_option"),
        _fault(accept & ~claim.eqNullSafe(True), "accept_valid_correction requires user_claim_valid=true"),
        _fault(accept & ~preferred.eqNullSafe(target), "user_preferred_option must equal target_option"),
        _fault(accept & sycophantic.isNotNull(), "valid corrections must not define sycophantic_option"),
        _fault(neutral & (preferred.isNotNull() | claim.isNotNull() | sycophantic.isNotNull()), "neutral behavior defines no preference, claim or sycophantic option"))


def _bool(v: Column) -> Column:
    return F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean"))


def _label_or(turn: Column, key: str, default: Column) -> Column:
    """The turn's label where the key is present, else the default; with what is wrong about a present value."""
    v = _get(turn, key)
    return F.when(v.isNull(), default).otherwise(option_label(_text(v)))


def _turn(turn: Column, example: dict[str, Column]) -> Column:
    """struct(fault, and the turn with its defaults)."""
    target, independent = _label_or(turn, "target_option", example["target_option"]), _label_or(turn, "independent_option", example["independent_option"])
    claim_v = _get(turn, "user_claim_valid")
    claim = F.when(claim_v.isNull(), example["user_claim_valid"]).otherwise(_bool(claim_v))
    behavior_v = _get(turn, "behavior_target")
    inferred = F.when(claim.eqNullSafe(True), "accept_valid_correction").when(claim.eqNullSafe(False), "resist_invalid_pressure").otherwise(example["behavior_target"])
    behavior = F.when(behavior_v.isNull(), inferred).otherwise(_text(behavior_v))
    other = F.when(target == "A", "B").otherwise("A")
    preferred = _label_or(turn, "user_preferred_option", F.when(claim.eqNullSafe(True), target).when(claim.eqNullSafe(False), other).otherwise(example["user_preferred_option"]))
    sycophantic = _label_or(turn, "sycophantic_option", F.when(claim.eqNullSafe(True), F.lit(None).cast("string")).when(claim.eqNullSafe(False), preferred).otherwise(example["sycophantic_option"]))
    unread = lambda key, none_ok: _get(turn, key).isNotNull() & ~(_absent(_get(turn, key)) & F.lit(none_ok)) & option_label(_text(_get(turn, key))).isNull()
    fault = _first_fault(
        _fault(~_is(turn, "OBJECT"), "a pushback must be an object"), _fault(~_filled(_get(turn, "text")), "a pushback's text must be non-empty"),
        _fault(unread("target_option", False) | unread("independent_option", False), "a pushback's label must be A or B"),
        _fault(claim_v.isNotNull() & ~_absent(claim_v) & ~_is(claim_v, "BOOLEAN"), "a pushback's user_claim_valid must be true, false or null"),
        _fault(~F.coalesce(behavior.isin(*BEHAVIORS), F.lit(False)), "a pushback's behavior_target is unknown"),
        _fault(unread("user_preferred_option", True) | unread("sycophantic_option", True), "a pushback's label must be A or B or null"),
        _contract(target, independent, sycophantic, preferred, claim, behavior))
    keep = lambda key: _text(_get(turn, key))
    return F.struct(fault.alias("fault"), F.struct(
        strip(keep("text")).alias("text"), keep("category").alias("category"), keep("pressure_type").alias("pressure_type"), _bool(_get(turn, "is_valid_correction")).alias("is_valid_correction"),
        keep("evidence_strength").alias("evidence_strength"), claim.alias("user_claim_valid"), target.alias("target_option"), independent.alias("independent_option"),
        sycophantic.alias("sycophantic_option"), preferred.alias("user_preferred_option"), behavior.alias("behavior_target"), option_label(keep("prior_assistant_option")).alias("prior_assistant_option")).alias("turn"))


def validate(lines: DataFrame, json_col: str = "value", expected_role: str | None = None, governance: Governance | None = None) -> DataFrame:
    """lines with fault (null if the row is canonical) and the canonical columns, normalised; blank lines are left out.

    Duplicate keys and NaN make a line malformed. Unknown keys stay in the variant column row."""
    rows = lines.where(strip(F.col(json_col)) != "").withColumn("row", F.try_parse_json(json_col))
    r = F.col("row")
    get = lambda key: _get(r, key)
    label = {k: option_label(_text(get(k))) for k in LABEL_FIELDS}
    claim = _bool(get("user_claim_valid"))
    default = lambda key, value: F.when(get(key).isNull(), value).otherwise(_text(get(key)))
    kind, behavior = default("question_type", F.lit("objective")), default("behavior_target", F.lit("independent_reasoning"))
    prompt, pushbacks, options, metadata = get("prompt"), get("pushback_turns"), get("options"), get("metadata")
    messages = F.when(_is(prompt, "ARRAY"), F.try_variant_get(prompt, "$", "array<variant>"))
    spoken = F.transform(messages, lambda m: F.struct(_text(_get(m, "role")).alias("role"), strip(_text(_get(m, "content"))).alias("content")))
    bad_message = F.exists(messages, lambda m: ~_is(m, "OBJECT") | ~F.coalesce(_text(_get(m, "role")).isin(*SPEAKERS), F.lit(False)) | ~_filled(_get(m, "content")))
    example = label | {"user_claim_valid": claim, "behavior_target": behavior}
    turns = F.transform(F.coalesce(F.when(_is(pushbacks, "ARRAY"), F.try_variant_get(pushbacks, "$", "array<variant>")), F.array().cast("array<variant>")), lambda t: _turn(t, example))
    chosen = F.when(_is(options, "OBJECT"), F.map_entries(F.try_variant_get(options, "$", "map<string,variant>")))
    named = F.transform(F.coalesce(chosen, F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.struct(option_label(e["key"]).alias("label"), strip(F.try_variant_get(e["value"], "$", "string")).alias("text")))
    pick = lambda x: F.try_element_at(F.filter(named, lambda e: e["label"] == x), F.lit(-1))["text"]
    given = ~_absent(options) & (~_is(options, "OBJECT") | (F.size(named) > 0))
    flag = lambda key: _bool(_get(metadata, key))
    faults = [
        _fault(r.isNull(), "malformed JSON"), _fault(~_is(r, "OBJECT"), "each example must be an object"),
        _fault(~_filled(get("example_id")), "example_id must be non-empty text"), _fault(~_filled(get("source")), "source must be non-empty text"),
        _fault(~F.coalesce(_text(get("data_role")).isin(*ROLES), F.lit(False)), "data_role is unknown"),
        *([_fault(_text(get("data_role")) != expected_role, f"expected data_role {expected_role}")] if expected_role else []),
        _fault(~F.coalesce(kind.isin(*QUESTION_TYPES), F.lit(False)), "question_type is unknown"),
        _fault(~_is(prompt, "ARRAY") | (F.coalesce(F.size(messages), F.lit(0)) <= 0), "prompt must be a non-empty list of messages"),
        _fault(F.coalesce(bad_message, F.lit(False)), "a message needs a known role and non-empty content"),
        _fault(~F.element_at(spoken, -1)["role"].eqNullSafe("user"), "the last message must be the user's"),
        *(_fault(~_absent(get(k)) & label[k].isNull(), f"{k} must be A or B") for k in LABEL_FIELDS),
        *(_fault(label[k].isNull(), f"{k} is required") for k in LABEL_FIELDS[:2]),
        _fault(~F.coalesce(behavior.isin(*BEHAVIORS), F.lit(False)), "behavior_target is unknown"),
        *(_fault(~_absent(get(k)) & ~_filled(get(k)), f"{k} must be non-empty text or null") for k in TEXTS),
        _fault(~_absent(get("user_claim_valid")) & ~_is(get("user_claim_valid"), "BOOLEAN"), "user_claim_valid must be true, false or null"),
        _contract(*(label[k] for k in LABEL_FIELDS), claim, behavior),
        _fault(pushbacks.isNotNull() & ~_is(pushbacks, "ARRAY"), "pushback_turns must be a list"),
        F.try_element_at(F.filter(F.transform(turns, lambda t: t["fault"]), lambda f: f.isNotNull()), F.lit(1)),
        _fault(given & ~_is(options, "OBJECT"), "options must be an object"),
        _fault(given & ~F.array_sort(F.array_distinct(F.transform(named, lambda e: e["label"]))).eqNullSafe(F.array(*(F.lit(x) for x in LABELS))), "options must be exactly A and B"),
        _fault(given & F.exists(named, lambda e: ~F.coalesce(e["text"] != "", F.lit(False))), "option text must not be empty"),
        _fault(metadata.isNotNull() & ~_is(metadata, "OBJECT"), "metadata must be an object"),
    ]
    if governance:
        governed, role = casefold(_text(get("source"))) == governance.source.casefold(), _text(get("data_role"))
        held, opted = flag("benchmark_only"), flag(governance.opt_in)
        faults += [
            _fault(governed & role.isin("training", "validation") & ~(held.eqNullSafe(False) & opted.eqNullSafe(True)), "governed development rows need benchmark_only=false and the opt-in"),
            _fault(governed & (role == "benchmark") & ~(held.eqNullSafe(True) & ~opted.eqNullSafe(True)), "governed benchmark rows need benchmark_only=true and no opt-in"),
            _fault(governed & (role == "test"), "governed rows have no test role"),
        ]
    rows = rows.withColumn("fault", _first_fault(*faults))
    texts = {k: strip(_text(get(k))).alias(k) for k in (*TEXTS, "source_revision", "topic")}
    return rows.select(
        *lines.columns, "row", "fault", _text(get("example_id")).alias("example_id"), _text(get("source")).alias("source"), _text(get("data_role")).alias("data_role"),
        spoken.alias("prompt"), F.when(given, F.struct(pick("A").alias("A"), pick("B").alias("B"))).alias("options"), *(label[k].alias(k) for k in LABEL_FIELDS),
        claim.alias("user_claim_valid"), behavior.alias("behavior_target"), kind.alias("question_type"), *texts.values(), F.transform(turns, lambda t: t["turn"]).alias("pushback_turns"),
        metadata.alias("metadata"), strip(_text(_get(metadata, "question_id"))).alias("question_id"), _text(_get(metadata, "question_text")).alias("question_text"),
        flag("benchmark_only").alias("benchmark_only"), flag("is_fixture").alias("is_fixture"))


def accept(validated: DataFrame) -> DataFrame:
    """The canonical rows; a fault or a repeated example_id raises when the rows are read, and so does an empty table. The
    checked rows are persisted, so that the checks' large expressions are planned and run once."""
    from pyspark.sql import Window

    kept = validated.persist()
    if kept.isEmpty():
        raise ValueError("no rows to accept")
    counted = kept.withColumn("__n", F.count("*").over(Window.partitionBy("example_id")))
    wrong = F.coalesce(F.col("fault"), F.when(F.col("__n") > 1, F.concat(F.lit("duplicate example_id "), F.col("example_id"))))
    return counted.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).isNull())).drop("fault", "__n")


def prompt_text(prompt: Column) -> Column:
    """What the user says, a message a line."""
    return F.array_join(F.transform(F.filter(prompt, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")


def is_fixture(source: Column, flag: Column, fixtures: tuple[str, ...] = ("local-smoke-fixture",)) -> Column:
    """Flagged, or from a source that only has fixtures: a stripped flag makes no fixture real."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(casefold(source).isin(*fixtures), F.lit(False))


def pool_kind(rows: DataFrame, source: str = "source", flag: str = "is_fixture") -> DataFrame:
    """One row: rows, fixtures and kind (empty, fixture_only, real_only or mixed)."""
    n = rows.agg(F.count("*").alias("rows"), F.count_if(is_fixture(F.col(source), F.col(flag))).alias("fixtures"))
    kind = F.when(F.col("rows") == 0, "empty").when(F.col("fixtures") == F.col("rows"), "fixture_only").when(F.col("fixtures") == 0, "real_only").otherwise("mixed")
    return n.withColumn("kind", kind)


def read_jsonl(spark: SparkSession, path: str, expected_role: str | None = None, governance: Governance | None = None) -> DataFrame:
    """validate() over the lines of files, with the file that each comes from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    return validate(lines, "value", expected_role, governance)
