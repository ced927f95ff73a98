"""Column -> Column helpers and named trip derivations."""

from cabflow.functions.core import above, at_least, exact_sum, round_dec, safe_div
from cabflow.functions import trips

__all__ = ["above", "at_least", "exact_sum", "round_dec", "safe_div", "trips"]
