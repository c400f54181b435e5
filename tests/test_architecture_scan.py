"""A whole architecture scan of a small tree: violations, cycles, patterns and the radar, by hand."""

import pytest

from quarry.operators import architecture
from quarry.plans.scan import architecture_scan
from quarry.sources.corpus import from_rows


@pytest.fixture(scope="module")
def tables(spark):
    many = "".join(f"    def m{i}(self):\n        pass\n" for i in range(30))
    rows = [
        (1, "shop/models/item.py", "python", "from shop.services import pay\nclass Item(A, B, C, D):\n    pass\n"),
        (1, "shop/services/pay.py", "python", "from shop.models import item\nclass Pay:\n    def get_instance(self):\n        return 1\n"),
        (1, "shop/views/page.py", "python", "import shop.services.pay\n" + "x = 1\n" * 600 + "class Page:\n" + many),
        (1, "shop/controllers/c.py", "python", "def run():\n" + "    y = 2\n" * 100),
        (1, "shop/routers/r.py", "python", "from shop.views.page import Page\n"),
        (1, "src/main/java/s/Face.java", "java", "interface Face {\n    void f();\n}\n"),
        (2, "a.py", "python", "import b\n"),
    ]
    return architecture_scan(from_rows(spark, rows))


def test_tables(tables):
    assert {tuple(r) for r in tables["violations"].collect()} == {
        (1, "layer", "shop.models.item -> shop.services.pay", "error"), (1, "godclass", "shop.views.page", "error"),
        (1, "overeng", "Face", "warning"),
    }
    assert [(r.scan_id, r.members, r.go_severity) for r in tables["cycles"].collect()] == [(1, ["shop.models.item", "shop.services.pay"], "minor")]
    assert {(r.scan_id, r.place, r.pattern, r.confidence) for r in tables["patterns"].collect()} == {(1, "Pay", "singleton", 0.9), (1, None, "mvc", 0.9), (1, None, "layered", 0.84)}
    fans = {r.module_id: (r.fan_in, r.fan_out) for r in tables["modules"].filter("scan_id = 1").collect()}
    assert fans["shop.services.pay"] == (2, 1) and fans["shop.views.page"] == (2, 1) and fans["s.Face"] == (0, 0)
    assert {(r.scan_id, r.kind): r.n for r in tables["summary"].collect()}[(1, "modules")] == 6


def test_radar(tables):
    r = tables["radar"].filter("scan_id = 1").first()
    # 6 modules of which 5 have a layer; 1 violation, 1 minor cycle, 1 god module; depth 2 but for one of 4
    assert (r.clarity, r.isolation, r.decoupling, r.cohesion, r.redundancy) == (83.3, 66.7, 98.0, 96.0, 100.0)
    assert r.discipline == 93.3 and tables["radar"].filter("scan_id = 2").first().clarity == 0.0


def test_styles_of_awkward_trees(spark):
    modules = spark.createDataFrame([(1, "x/controllers/models/views/a.py"), (1, "views/a.py"), (2, "routers/services/engines/models/b.py"), (3, None), (4, "a.py")], "scan_id long, file_path string")
    assert {tuple(r) for r in architecture.directory_styles(modules).collect()} == {(1, "mvc", 0.9), (2, "layered", 0.84)}
