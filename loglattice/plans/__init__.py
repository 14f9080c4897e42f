"""Plan-shaping helpers: size-checked broadcasts, hot keys, ordered blocks, lineage cuts."""
