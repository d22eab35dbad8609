import __spark_entry__ as entry
from wattloom import registry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 80


def test_library_does_not_import_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
