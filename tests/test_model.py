import warnings

import pytest

from weftline.design import build, plan, schema
from weftline.errors import MappingError, OntologyError, PlanError
from weftline.model import mapping, naming, ontology, turtle
from weftline.star import ONTOLOGY, library

HEAD = """
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix ex: <https://example.org/x#> .
@prefix other: <https://example.org/other#> .
"""


def classes(*names):
    return "".join(f"ex:{n} a owl:Class .\n" for n in names)


def relation(name, a, b, comment=""):
    note = f' rdfs:comment "{comment}" ;' if comment else ""
    return f"ex:{name} a owl:ObjectProperty ;{note} rdfs:domain {a} ; rdfs:range {b} .\n"


@pytest.mark.parametrize(("name", "snake", "table"), [("Loan", "loan", "p_loans"), ("LoanType", "loan_type", "p_loan_types"), ("SSNNumber", "s_s_n_number", "p_s_s_n_numbers"), ("City", "city", "p_cities"), ("Species", "species", "p_species"), ("Hero", "hero", "p_heros")])
def test_names(name, snake, table):
    assert naming.snake(name) == snake
    assert naming.table_name("p", name) == table
    assert naming.key_name("p", name) == f"p_{snake}_id"


def test_turtle_forms():
    triples, prefixes = turtle.parse('@base <http://b/> . @prefix e: <http://e/> .\ne:s e:p "a\\"b" , 3 ; a e:T ; e:q ( e:x e:y ) , [ e:r true ] . <rel> e:p "x"@en , "1"^^e:t , """two\nlines""" . # end')
    assert prefixes == {"e": "http://e/"}
    values = [o for _, p, o in triples if p == "http://e/p"]
    assert [v.value for v in values] == ['a"b', "3", "x", "1", "two\nlines"]
    assert values[2].lang == "en"
    assert values[3].datatype == "http://e/t"
    assert ("http://b/rel", "http://e/p", values[2]) in triples
    assert sum(p == turtle.FIRST for _, p, _ in triples) == 2


@pytest.mark.parametrize("text", ["e:a e:b e:c .", '@prefix e: <http://e/> . e:a e:b "open .', "@prefix e: <http://e/> . e:a e:b e:c", "@prefix e: <http://e/> . e:a ( e:b ) ."])
def test_turtle_errors(text):
    with pytest.raises(OntologyError):
        turtle.parse(text)


def test_ontology_kinds():
    o, *_ = library()
    assert [c.name for c in o.classes] == ["Author", "Book", "Branch"]
    assert o.value_sets[0].codes == ["novel", "short_story", "poetry"]
    assert ontology.parse(ONTOLOGY.replace("\n", "\r\n")).digest == o.digest


def test_plan_and_schema():
    _, p, s, m = library()
    assert p["valid"]
    assert {r["kind"] for r in p["relationships"]} == {"fk", "junction"}
    assert s["creation_order"][0] == "lib_authors"
    books = next(t for t in s["tables"] if t["name"] == "lib_books")
    genre = next(c for c in books["columns"] if c["name"] == "genre")
    assert genre["references"] == {"table": "lib_genre_values", "column": "code"}
    assert genre["allowed_values"] == ["novel", "short_story", "poetry"]
    assert m.relations["writtenBy"].junction == "lib_book_authors"
    assert m.path("Book", "Author") == m.relations["writtenBy"].steps
    assert m.path("Branch", "Book") == m.relations["heldAt"].steps
    assert mapping.ownership(m, "Branch") == {"lib_branchs": "lib_branch_id", "lib_books": "lib_branch_id"}
    assert "CREATE TABLE lib_books" in schema.ddl(s)
    assert "genre: string, one of novel" in schema.describe(s)
    assert schema.validation_spec(s)["lib_books"]["allowed"]["genre"][0] == "novel"


def test_circle_is_an_error():
    p = plan.design(ontology.parse(HEAD + classes("A", "B") + relation("ab", "ex:A", "ex:B") + relation("ba", "ex:B", "ex:A")))
    assert not p["valid"]
    assert "ex_as -> ex_bs -> ex_as" in p["errors"][0]


def test_long_chain_has_no_recursion_limit():
    n = 3000
    links = [{"kind": "fk", "child_table": f"t{i}", "parent_table": f"t{i + 1}"} for i in range(n)]
    levels, loops = plan.creation_levels([f"t{i}" for i in range(n + 1)], links)
    assert len(levels) == n + 1
    assert not loops


def test_self_reference_is_no_circle():
    p = plan.design(ontology.parse(HEAD + classes("A") + relation("up", "ex:A", "ex:A")))
    assert p["valid"]
    assert p["creation_order"] == [{"level": 0, "tables": ["ex_as"]}]


def test_union_is_dropped_with_a_warning():
    text = HEAD + classes("A", "B", "C") + "ex:u a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( ex:A ex:B ) ] ; rdfs:range ex:C ."
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        p = plan.design(ontology.parse(text))
    assert len(seen) == 1
    assert p["relationships"] == []


def test_overrides(tmp_path):
    o = ontology.parse(HEAD + classes("Loan", "Payment") + relation("hasPayment", "ex:Loan", "ex:Payment"))
    assert plan.design(o)["relationships"][0]["child_table"] == "ex_loans"
    for key in ("hasPayment", "ex:hasPayment", "https://example.org/x#hasPayment"):
        r = plan.design(o, {"fk_parent": {key: "domain"}})["relationships"][0]
        assert (r["child_table"], r["fk_column"], r["parent_table"]) == ("ex_payments", "ex_loan_id", "ex_loans")
    assert plan.design(o, {"junction_relations": [["https://example.org/x#Loan", "https://example.org/x#Payment"]]})["relationships"][0]["junction_table"] == "ex_loan_payments"
    assert [m["name"] for m in plan.design(o, {"modules": {"money": ["Payment"]}})["modules"]] == ["ex", "money"]
    assert len(plan.design(o, {"ignore_classes": ["Payment"]})["tables"]) == 1
    with pytest.raises(PlanError, match="hasPayments"):
        plan.design(o, {"fk_parent": {"hasPayments": "domain"}})
    (tmp_path / "o.yaml").write_text("fk_parents: {}\n")
    with pytest.raises(PlanError, match="fk_parents"):
        plan.load_overrides(tmp_path / "o.yaml")
    assert plan.load_overrides(tmp_path / "none.yaml") == {}


def test_junction_names_and_double_keys():
    many = "A many-to-many link."
    p = plan.design(ontology.parse(HEAD + classes("Foo", "Bar") + relation("link", "ex:Foo", "ex:Bar", many) + relation("secondaryLink", "ex:Foo", "ex:Bar", many)))
    assert [r["junction_table"] for r in p["relationships"]] == ["ex_foo_bars", "ex_foo_bars_secondary_link"]
    p = plan.design(ontology.parse(HEAD + classes("Foo", "Bar") + relation("one", "ex:Foo", "ex:Bar") + relation("two", "ex:Foo", "ex:Bar")))
    assert not p["valid"]


def test_written_plan_is_kept_when_wrong(tmp_path):
    p = plan.design(ontology.parse(HEAD + classes("A", "B") + relation("ab", "ex:A", "ex:B") + relation("ba", "ex:B", "ex:A")))
    with pytest.raises(PlanError):
        plan.write(p, tmp_path / "plan.yaml")
    assert "valid: false" in (tmp_path / "plan.yaml").read_text()


def test_build_cache(tmp_path):
    o, p, _, _ = library()
    first = build.build(p, o, tmp_path)
    file = tmp_path / "lib.json"
    file.write_text(file.read_text().replace('"integer"', '"decimal"'))
    assert build.build(p, o, tmp_path) != first  # the cache counts while its slice is the same
    file.write_text("{ broken")
    assert build.build(p, o, tmp_path) == first
    file.write_text(file.read_text().replace('"slice_hash": "', '"slice_hash": "x'))
    assert build.build(p, o, tmp_path) == first


def test_build_checks():
    o, p, _, _ = library()
    part = build.module_slice("lib", p["modules"][0]["tables"], p, o)
    good = build.build_module(part)
    assert build.check_build(good, part) == []
    column = good["tables"][0]["columns"][0]
    for key, value in (("name", "Bad Name"), ("type", "float"), ("unique", "yes"), ("name", "created_at")):
        kept = column[key]
        column[key] = value
        assert len(build.check_build(good, part)) == 1
        column[key] = kept
    good["tables"].append({"name": "strange", "columns": []})
    del good["tables"][0]
    assert len(build.check_build(good, part)) == 2


def test_reconcile_refuses():
    o, p, _, _ = library()
    builds = build.build(p, o)
    with pytest.raises(PlanError, match="changed"):
        schema.reconcile(p | {"ontology_hash": "x"}, builds, o)
    with pytest.raises(PlanError, match="not valid"):
        schema.reconcile(p | {"valid": False, "errors": ["e"]}, builds, o)
    with pytest.raises(PlanError, match="no build"):
        schema.reconcile(p, {}, o)
    books = next(t for t in builds["lib"]["tables"] if t["name"] == "lib_books")
    books["columns"].append({"name": "lib_branch_id", "type": "integer"})
    with pytest.raises(PlanError, match="foreign key"):
        schema.reconcile(p, builds, o)


def test_mapping_errors():
    o, _, s, _ = library()
    good = mapping.from_schema(s, o)
    for change, message in (({"tables": {"Film": {"table": "f", "primary_key": "k"}}}, "Film"), ({"tables": {"Book": {"table": "b"}}}, "primary_key"), ({"relations": {"filmedBy": {"type": "direct"}}}, "filmedBy"), ({"relations": {"heldAt": {"type": "odd"}}}, "odd"), ({"relations": {"heldAt": {"type": "direct", "fk_table": "lib_books"}}}, "lacks")):
        with pytest.raises(MappingError, match=message):
            mapping.from_dict({k: {**good[k], **change.get(k, {})} for k in ("tables", "relations")}, o)


def test_renamed_columns():
    m = mapping.from_dict({"tables": {"Pet": {"table": "animals", "primary_key": "animal_id", "columns": {"pet_name": "name", "weight": {"iri": "i", "column": "kg"}}}}})
    t = m.table("Pet")
    assert (t.physical("pet_name"), t.physical("weight"), t.physical("other")) == ("name", "kg", "other")
    assert t.column_iris == {"weight": "i"}
    assert m.by_table("animals") is t


def test_self_references_and_circles_name_their_properties():
    p = plan.design(ontology.parse(HEAD + classes("A", "B") + relation("boss", "ex:A", "ex:A") + relation("ab", "ex:A", "ex:B") + relation("ba", "ex:B", "ex:A")))
    assert [r["table"] for r in p["self_references"]] == ["ex_as"]
    assert "(by ab, ba)" in p["errors"][0]
