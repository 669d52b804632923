"""The queries of the library's own operators, and the same in SQL."""

from __future__ import annotations

from brakta.queries import detection, generators, layout, people, rows, scores, search, sessions

_MODULES = (detection, layout, rows, scores, generators, sessions, search, people)
#: Queries on rows written down in the code, kept as unit tests (tests/test_oracle.py): they read no table, so they are not registered.
FIXED = frozenset("""
    clean_raw_candidates table_detector regex_modes mask_overlapping custom_label_keys label_dimension labels_per_tier label_meta default_rules changed_rules toggled_labels removed_label browser_labels detector_labels
    polygon_lines label_meta_with_custom parsed_mappings coerced_entities sparse_entities parsed_records validated_entities cleaned_entities flattened_entities validated_records matched_addresses
    sensitivity_classes person_records ownership tasks_from_records dense_entities training_examples task_coverage cleaned_splits pinned_pools demo_page demo_spans
""".split())
ALL = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
QUERIES = {name: f for name, f in ALL.items() if name not in FIXED}
#: With those of fixed rows.
ALL_SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
SQL = {name: s for name, s in ALL_SQL.items() if name not in FIXED}
