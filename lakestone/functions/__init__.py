"""Column-level helpers (all built-in Spark expressions, codegen-friendly)."""

from lakestone.functions.numeric import round_half_away, percent, pairs, per_unit, mebibytes
from lakestone.functions.draws import uniform01, uniform, normal, std_normal, randint, choice, weighted_choice, hash_score
from lakestone.functions.text import clean_null_tokens, file_stem, iso_seconds, NULL_TOKENS, ISO_SECONDS
from lakestone.functions.transform import trig_score, hash_prefix

__all__ = [
    "round_half_away", "percent", "pairs", "per_unit", "mebibytes",
    "uniform01", "uniform", "normal", "std_normal", "randint", "choice", "weighted_choice", "hash_score",
    "clean_null_tokens", "file_stem", "iso_seconds", "NULL_TOKENS", "ISO_SECONDS",
    "trig_score", "hash_prefix",
]
