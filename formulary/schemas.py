"""Schemas of the records at the file boundary; they are passed to every reader, never inferred."""

from pyspark.sql import types as T

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


PAIR_FILE = _struct(("NL", _s), ("FOL", _s))
EXAMPLE_FILE = _struct(("premises", T.ArrayType(_s)), ("conclusion", _s), ("label", _s))
EXAMPLE_RESULT_FILE = _struct(
    ("premises", T.ArrayType(_s)),
    ("premises-FOL", T.ArrayType(_s)),
    ("conclusion", _s),
    ("conclusion-FOL", _s),
    ("label", _s),
)
# Every stored spelling of a result column; a file holds some of them.
RESULT_FILE = _struct(
    ("NL", _s),
    ("PROMPT", _s),
    ("PRED", _s),
    ("FOL_PRED", _s),
    ("GROUND-TRUTH", _s),
    ("FOL_GROUND-TRUTH", _s),
    ("FOL-GROUND-TRUTH", _s),
    ("PREDICATES_PRED", _s),
    ("PREDICATES_GROUND-TRUTH", _s),
    ("PREDICATES-GROUND-TRUTH", _s),
    ("FOL_PRED_REASONING", _s),
    ("FALLBACK_USED", _b),
)
ANSWERED = _struct(("nl", _s), ("prompt", _s), ("fol_pred", _s), ("fol_gt", _s))

NODE = _struct(
    ("node_id", _i),
    ("parent_id", _i),
    ("pos", _i),
    ("kind", _s),
    ("symbol", _s),
    ("depth", _i),
    ("quantifier_depth", _i),
    ("arity", _i),
    ("free", _b),
)
