from assay.functions.identity import case_key, content_id, hash_rank, hash_unit
from assay.functions.stats import mcnemar_exact, wilson

__all__ = ["case_key", "content_id", "hash_rank", "hash_unit", "mcnemar_exact", "wilson"]
