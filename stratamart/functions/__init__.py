from stratamart.functions.columns import (  # noqa: F401
    age_years,
    bin_right_closed,
    clean_output,
    day_of_week,
    is_email,
    rfm_score,
    mean,
    ratio,
    title_case,
    trim_space,
    whole_days,
)
