"""The worked domains: a plan against its stored form, and each domain used as a reader of README would."""

import shutil
from pathlib import Path

import pytest

from weftline import domain
from weftline.engine import Engine
from weftline.model import mapping as maps
from weftline.model import ontology as onto
from weftline.sources.catalog import ParquetCatalog
from weftline.star import CASTS

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture
def copied(tmp_path):
    """A domain's folder, where files may be written."""
    return lambda name: domain.load(shutil.copytree(ROOT / "domains" / name, tmp_path / name))


def test_domains_are_found():
    assert domain.available(ROOT / "domains") == ["clinic", "library", "orders"]


def test_plan_is_the_stored_one(copied):
    d = copied("clinic")
    domain.design(d)
    assert d.made("schema_plan", d.source()).read_text() == (ROOT / "tests/golden/clinic_schema_plan.yaml").read_text()


def test_first_example_of_the_readme(spark, copied, tmp_path):
    d = copied("library")
    made = domain.design(d)
    domain.install(spark, made, str(tmp_path / "store"), rows=10)
    engine = domain.engine(spark, d, str(tmp_path / "store"))
    genre = engine.source.table("lib_books").first()["genre"]
    ask = {"op": "query", "entity": "Book", "filters": {"genre": genre}, "relations": [{"rel": "heldAt", "entity": "Branch"}], "fields": ["title"], "sort": {"field": "title"}, "limit": 10}
    result = engine.execute([ask, {"op": "action", "action": "long_books", "params": {"pages": 0}}])
    assert result.ok
    assert result.log[0]["total"] > 0
    assert result.log[1]["result"] == "10"
    assert engine.frame(ask).columns == ["title"]
    assert "long_books" in str(engine.tool())
    readme = (ROOT / "README.md").read_text()
    assert 'domain.load("domains/library")' in readme


def test_a_mapping_written_by_hand_onto_tables_that_exist(spark):
    d = domain.load(ROOT / "domains/orders")
    m = maps.load(d.source().mapping, onto.load(d.ontology))
    engine = Engine(spark, m, ParquetCatalog(spark, SF, CASTS), owned=maps.ownership(m, d.identity_entity), paths=maps.owner_paths(m, d.identity_entity))
    ask = {"op": "query", "entity": "LineItem", "relations": [{"rel": "lineOfOrder", "entity": "Order", "filters": {"status": "F"}}], "aggregate": {"fn": "count"}}
    lines, orders = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'F'")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    assert engine.execute([ask]).text == str(both.count())
    assert engine.execute([ask], identity=7).text == str(both.where("o_custkey = 7").count())


def test_scope_along_keys_in_a_designed_domain(spark, copied, tmp_path):
    d = copied("clinic")
    domain.install(spark, domain.design(d), str(tmp_path / "store"), rows=6)
    ask = [{"op": "query", "entity": e, "aggregate": {"fn": "count"}} for e in ("Visit", "Finding", "Invoice", "Payment", "Drug")]
    wide = domain.engine(spark, d, str(tmp_path / "store")).execute(ask, identity=1)
    near = domain.engine(spark, d, str(tmp_path / "store"), transitive=True).execute(ask, identity=1)
    store = domain.engine(spark, d, str(tmp_path / "store")).source
    visits = store.table("cl_visits").where("cl_patient_id = 1").select("cl_visit_id")
    invoices = store.table("bil_invoices").join(visits, "cl_visit_id", "left_semi").select("bil_invoice_id")
    assert wide.text.split("\n") == [str(visits.count()), "6", "6", "6", "6"]
    assert near.text.split("\n") == [str(visits.count()), str(store.table("cl_findings").join(visits, "cl_visit_id", "left_semi").count()), str(invoices.count()), str(store.table("bil_payments").join(invoices, "bil_invoice_id", "left_semi").count()), "6"]
