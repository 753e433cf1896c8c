from .text import (  # noqa: F401
    detokenize, detruecase, factor_stream, lowercase, n_tokens, normalize_all_caps,
    normalize_punctuation, postprocess, strip_nonprinting, strip_tags, strip_ws, tag_prefix,
    tag_token, tokenize, tokens, undo_subword,
)
