from tessera.functions.names import (  # noqa: F401
    slugify, slugify_col, unique_names, normalized_names, resolve_name, guess_target,
    drop_by_suffix, q,
)
from tessera.functions.values import (  # noqa: F401
    DEFAULT_MISSING_TOKENS, INVALID_PATTERN, NUMERIC_PATTERN, missing_tokens, trim_ws,
    null_if_token, null_if_invalid, strict_double, to_double, binarize, uniform01, md5_key,
)
from tessera.functions.stats import sample_skew, sample_kurt, safe_corr, t_pvalue  # noqa: F401
