import pytest

from weftline.functions.actions import Actions
from weftline.functions.literals import coerce
from weftline.errors import CompileError, StoreError
from weftline.plans.operations import Call, Create, Delete, Link, Query, Update, parse
from weftline.plans.tool import tool_schema
from weftline.plans.validate import validate
from weftline.sources import inserts
from weftline.star import library, star_mapping
from pyspark.sql import types as T


def test_parse_each_kind():
    assert isinstance(parse({"op": "query", "entity": "Book", "limit": 2.9}), Query)
    assert parse({"op": "query", "limit": 2.9}).limit == 2
    assert parse({"op": "query", "fields": "name", "filters": [1], "sort": {"field": "a"}}) == Query("", sort=("a", "asc"))
    assert isinstance(parse({"op": "create"}), Create)
    assert isinstance(parse({"op": "update"}), Update)
    assert isinstance(parse({"op": "delete"}), Delete)
    assert parse({"op": "unlink", "from": {"entity": "A"}}).op == "unlink"
    assert isinstance(parse({"op": "link"}), Link)
    assert isinstance(parse({"op": "action", "action": "x"}), Call)
    assert parse({"op": "drop"}) is None
    assert parse(None) is None


def test_errors_are_numbered_only_in_batches():
    m = library()[3]
    bad = {"op": "query", "entity": "Film"}
    assert validate([bad], m)[0].startswith("query")
    assert [e.split(":")[0] for e in validate([bad, {"op": "query", "entity": "Book"}, bad], m)] == ["operation 1", "operation 3"]
    assert validate([], m)
    assert validate(["x"], m)


def test_physical_names_are_not_fields():
    m = star_mapping()
    assert validate([{"op": "query", "entity": "Order", "fields": ["o_orderstatus"]}], m)
    assert validate([{"op": "query", "entity": "Order", "filters": {"o_custkey": 1}}], m)


def test_every_check_applies_to_every_crud_operation():
    m = library()[3]
    assert validate([{"op": "delete", "entity": "Book", "sort": {"field": "isbn"}}], m)
    assert not validate([{"op": "delete", "entity": "Book", "resolve": {"heldAt": {"entity": "Branch", "filters": {}}}}], m)


def test_link_ends_in_either_order():
    m = library()[3]
    book, author = {"entity": "Book", "filters": {"title": "x"}}, {"entity": "Author", "filters": {"full_name": "y"}}
    for a, b in ((book, author), (author, book)):
        assert validate([{"op": "link", "relation": "writtenBy", "from": a, "to": b}], m) == []
    assert validate([{"op": "link", "relation": "writtenBy", "from": book, "to": book}], m)


def test_tool_has_the_names():
    actions = Actions()
    actions.register("scan", lambda *a: "")
    m = library()[3]
    tool = tool_schema(m, actions)
    fields = tool["input_schema"]["properties"]["operations"]["items"]["properties"]
    assert fields["entity"]["enum"] == ["Author", "Book", "Branch"]
    assert fields["relation"]["enum"] == ["writtenBy"]
    assert list(fields["resolve"]["properties"]) == ["heldAt"]
    assert fields["from"]["properties"]["entity"]["enum"] == ["Author", "Book"]
    assert fields["action"]["enum"] == ["scan"]
    fields["entity"]["enum"].append("Film")
    assert tool_schema(m)["input_schema"]["properties"]["operations"]["items"]["properties"]["entity"]["enum"] == ["Author", "Book", "Branch"]


@pytest.mark.parametrize(("value", "kind", "expected"), [("5", T.IntegerType(), 5), (5.0, T.LongType(), 5), ("1.005", T.DecimalType(12, 2), "1.01"), ("2024-01-02", T.DateType(), "2024-01-02"), ("2024-01-02", T.TimestampNTZType(), "2024-01-02 00:00:00"), ("true", T.BooleanType(), "True"), (None, T.StringType(), "None")])
def test_literals(value, kind, expected):
    assert str(coerce(value, kind, "c")) == str(expected)


@pytest.mark.parametrize(("value", "kind"), [("abc", T.IntegerType()), (True, T.IntegerType()), (2**31, T.IntegerType()), (1.5, T.IntegerType()), (5, T.StringType()), ([1], T.StringType()), ("maybe", T.BooleanType()), ("1e20", T.DecimalType(12, 2)), ("soon", T.DateType())])
def test_wrong_literals_are_errors(value, kind):
    with pytest.raises(CompileError):
        coerce(value, kind, "c")


def test_insert_text():
    text = "INSERT INTO t (a, b) VALUES (1, 'x; (y''z)'), (2, NULL); -- note; more\nCREATE TABLE u (c int);\ninsert into v (d) values (TRUE)"
    assert [(i.table, i.rows) for i in inserts.read(text)] == [("t", (("1", "x; (y'z)"), ("2", None))), ("v", ((True,),))]
    assert inserts.split("a, (b, c), 'd, e'", ",") == ["a", "(b, c)", "'d, e'"]
    with pytest.raises(StoreError):
        inserts.read("INSERT INTO t (a, b) VALUES (1)")
    with pytest.raises(StoreError):
        inserts.read("INSERT INTO t (a) VALUES (now())")


def test_action_folder(tmp_path):
    (tmp_path / "one.py").write_text("DEFINITION = {'name': 'one', 'description': 'd'}\ndef execute(params, context, mapping):\n    return 'done'\n")
    (tmp_path / "_two.py").write_text("raise ValueError")
    (tmp_path / "three.py").write_text("x = 1\n")
    actions = Actions()
    assert actions.load(tmp_path) == ["one"]
    assert actions.get("one").run({}, None, None) == "done"
    assert actions.definitions()[0]["description"] == "d"
    actions.clear()
    assert actions.names() == []
    assert actions.load(tmp_path / "none") == []
