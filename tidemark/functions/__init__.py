from tidemark.functions.stats import finite, noise_floor, pooled_share, quantile_noise, sigmoid
from tidemark.functions.text import case_fold, normal_path, normal_spelling

__all__ = ["case_fold", "finite", "noise_floor", "normal_path", "normal_spelling", "pooled_share", "quantile_noise", "sigmoid"]
