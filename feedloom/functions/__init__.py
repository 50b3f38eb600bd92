"""Column -> Column building blocks (all JVM-side built-ins, no Python UDFs)."""

from feedloom.functions.clean import (  # noqa: F401
    clean_email_value,
    duration_seconds,
    email_is_valid,
    is_dash,
    parse_date,
    parse_datetime,
    phone_digits_es,
    phone_is_valid_es,
    recode,
    to_number,
    yes_no_bool,
    yes_no_ok,
    zfill5,
)
from feedloom.functions.delays import delay_days  # noqa: F401
from feedloom.functions.text import (  # noqa: F401
    fold_accents,
    has_more_words,
    slug,
    strip_ws,
    word_count,
)
