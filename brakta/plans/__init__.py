"""Physical helpers shared by the operators: lineage cuts and size-checked joins."""
