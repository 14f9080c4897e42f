"""Which test stands for each training-data query that SQL cannot express."""

import ast
import os

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.abspath(__file__))
WITHOUT_SQL = {
    "op1_html_text": "test_content_model_on_pages_it_has_not_seen",
    "op2_sentencepiece": "test_sentencepiece_equals_the_library",
    "op3_simhash": "test_simhash_components_equal_brute_force",
    "op4_packing": "test_packing_covers_every_id_once",
    "op5_nearest": "test_nearest_with_hot_vectors_and_odd_ones",
    "op7_suffix_dedup": "test_suffix_dedup_equals_brute_force",
    "op8_fingerprints": "test_edited_fingerprints",
    "op10_quality": "test_quality_on_held_out_rows",
    "op12_conversation_repair": "test_repair_agrees_with_brute_force",
    "op13_importance": "test_resample_agrees_with_brute_force",
    "pipeline": "test_every_token_is_packed_once",
}


def _tests():
    for name in os.listdir(HERE):
        if name.endswith(".py"):
            with open(os.path.join(HERE, name)) as f:
                yield from (n.name for n in ast.walk(ast.parse(f.read())) if isinstance(n, ast.FunctionDef))


def test_every_query_has_sql_or_a_named_test():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert without == set(WITHOUT_SQL)
    assert set(WITHOUT_SQL.values()) <= set(_tests())
