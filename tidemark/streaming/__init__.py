from tidemark.streaming.drift import drift, monitor, window_counts, window_profiles

__all__ = ["drift", "monitor", "window_counts", "window_profiles"]
