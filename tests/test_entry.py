import __spark_entry__ as E


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 200


def test_entry(spark):
    assert E.entry(spark).count() == 5


def test_guard():
    """Nothing but the entry module's guard and the llm folders know the llm subpackage."""
    import pathlib

    root = pathlib.Path(E.__file__).parent / "lumenframe"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lumenframe.llm" in p.read_text()]
