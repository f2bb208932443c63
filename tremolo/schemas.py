"""Explicit schemas of the record types."""

from pyspark.sql import types as T


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

PROMPT_PAIR = _of(pair_id=_S, task_type=_S, source_benchmark=_S, prompt_a=_S, prompt_b=_S, response_being_judged=_S, ground_truth_label=_S, semantic_equivalence_score=_D)
JUDGMENT = _of(
    pair_id=_S, task_type=_S, model=_S, run=_I, prompt_a_decision=_S, prompt_b_decision=_S, normalized_a=_S, normalized_b=_S,
    flipped=_B, prompt_a_raw=_S, prompt_b_raw=_S, timestamp=_S, error=_S,
)
LEGACY_JUDGMENT = T.StructType([*JUDGMENT.fields, *_of(prompt_a_decision_raw=_S, prompt_b_decision_raw=_S, run_number=_I).fields])
AUTO_VALIDATION = _of(pair_id=_S, task_type=_S, validation_decision=_S, raw_response=_S, error=_S)
MANUAL_VALIDATION = _of(pair_id=_S, task_type=_S, manual_label=_S, note=_S, reviewer=_S, timestamp=_S)
METRICS = _of(model=_S, task_type=_S, jss=_D, flip_rate=_D, cohens_kappa=_D, ci_lower=_D, ci_upper=_D, n_pairs=T.LongType(), n_flips=T.LongType())
