from tidemark.functions.metrics import (
    UNITS,
    money,
    money_units,
    none_if_all,
    optional_eq,
    pct2,
    round_ratio,
    signed_pct2,
)
from tidemark.functions.text import money_text, number_text, percent_text, with_text_times

__all__ = [
    "UNITS",
    "money",
    "money_text",
    "money_units",
    "none_if_all",
    "number_text",
    "optional_eq",
    "pct2",
    "percent_text",
    "round_ratio",
    "signed_pct2",
    "with_text_times",
]
