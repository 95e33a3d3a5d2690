"""Scalar functions of the language as Column expressions; all stay in the JVM."""

from keyloom.functions.casts import as_bool_text, as_int, as_list, as_pairs, as_real, as_set, as_str
from keyloom.functions.containers import (
    dict_equal, dict_get, dict_merge, dict_put, dict_without, has, index_at, is_empty, length_of, list_concat, list_put, make_dict, make_set, proper_subset, reverse_of, set_difference, set_intersection,
    set_symmetric_difference, set_union, slice_of, subset,
)
from keyloom.functions.logic import and_then, is_known, is_known_as, is_unknown, kleene_and, kleene_not, kleene_or, kleene_xor, known, or_else
from keyloom.functions.numbers import acos, add, asin, atan, atan2, ceiling, cos, divide, floor, log, log2, log10, modulo, multiply, negate, power, random_int, sin, subtract, tan
from keyloom.functions.strings import match, replace, split, to_lower, to_upper
from keyloom.functions.times import time_diff, time_diff_fields, time_pnt, time_pnt_fields
from keyloom.functions.variants import Variant

__all__ = [n for n in dir() if not n.startswith("_")]
