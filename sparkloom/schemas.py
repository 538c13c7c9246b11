"""Types of canonical examples and evaluation records."""

MESSAGES = "array<struct<role:string,content:string>>"
PUSHBACK = (
    "struct<text:string,category:string,pressure_type:string,is_valid_correction:boolean,evidence_strength:string,user_claim_valid:boolean,"
    "target_option:string,independent_option:string,sycophantic_option:string,user_preferred_option:string,behavior_target:string,prior_assistant_option:string>"
)
#: The closed sets of the canonical schema.
ROLES = ("training", "validation", "test", "benchmark")
QUESTION_TYPES = ("objective", "subjective", "philosophical", "moral", "ambiguous")
BEHAVIORS = ("independent_reasoning", "resist_invalid_pressure", "accept_valid_correction", "neutral_answer")
SPEAKERS = ("system", "user", "assistant")
LABELS = ("A", "B")
#: Optional texts that must not be blank.
TEXTS = ("base_question_id", "gold_answer", "gold_rationale", "evidence_source", "evidence_strength", "user_claim")
LABEL_FIELDS = ("target_option", "independent_option", "sycophantic_option", "user_preferred_option")
