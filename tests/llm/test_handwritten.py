import pytest
from pyspark.sql import functions as F

from tessella.llm import handwritten as h


@pytest.mark.parametrize(
    "path, kind",
    [
        ("r/web/node_modules/x/lib/a.js", "vendored"), ("r/vendor/mod/a.go", "vendored"), ("r/src/vendors/a.ts", None), ("r/src/vendor_portal/A.java", None), ("r/x/external/pkg-1.2.3/a.rs", "vendored"),
        ("r/x/external_orders/a.ts", None), ("r/api/user_pb2.py", "generated"), ("r/lib/a.g.dart", "generated"), ("r/pkg/zz_generated.deepcopy.go", "generated"), ("r/a/generator_x.go", None), ("r/packages/x/dist/a.js", "generated"),
        ("r/src/dist/x_density.py", None), ("r/public/a.min.js", "minified"), ("r/www/index.0305edee0d.js", "minified"), ("r/src/a/stateMinimal.js", None), ("r/yarn.lock", "lockfile"), ("r/scripts/build/a.py", None), ("r/x/build.rs", None), (None, None),
    ],
)
def test_paths(spark, path, kind):
    files = spark.createDataFrame([(1, path, 500, "h", None)], "id long, path string, size long, hash string, last_indexed_at timestamp_ntz")
    symbols = spark.createDataFrame([], "id long, file_id long, name string, line int")
    assert h.classify(files, symbols).head().reason == kind


def test_evidence_beyond_paths(spark, moment):
    files = spark.createDataFrame(
        [
            (1, "r/node_modules/p/a.js", 100, "same", moment(1), ""), (2, "q/src/mine.js", 100, "same", moment(1), ""), (3, "r/vendor/empty.go", 0, "none", moment(1), ""), (4, "r/src/empty.go", 0, "none", moment(1), ""),
            (5, "r/src/squeezed.js", 90_000, "a", moment(1), ""), (6, "r/src/table.py", 900_000, "b", moment(1), ""), (7, "r/src/large.py", 400_000, "c", moment(1), ""), (8, "r/src/old.min.js", 1, "d", moment(1), ""), (8, "r/src/now.js", 1, "d", moment(2), ""),
            (9, "r/src/told.go", 10, "e", None, "// Code generated by tool. DO NOT EDIT."), (10, "r/src/x.py", None, None, None, None), (None, "r/node_modules/n.js", 1, "z", None, None),
        ],
        "id long, path string, size long, hash string, last_indexed_at timestamp_ntz, head string",
    )
    symbols = [(i, 5, n, 1) for i, n in enumerate(["a", "bX", "c", "d"])] + [(10, 6, "only", 1)] + [(20 + i, 7, f"function{i}", 100 * i) for i in range(100)] + [(200, None, "x", None), (201, 10, None, None)]
    found = {r.file_id: r.reason for r in h.classify(files, spark.createDataFrame(symbols, "id long, file_id long, name string, line int"), "head").collect()}
    assert found == {1: "vendored", 2: "third_party_copy", 3: "vendored", 4: None, 5: "minified", 6: "data", 7: None, 8: None, 9: "generated", 10: None}
    assert h.classify(files.limit(0), spark.createDataFrame([], "id long, file_id long, name string, line int")).count() == 0


def test_notices(spark):
    df = spark.createDataFrame([("/* @generated */",), ("we generate things",), (None,), ("",), ("x" * 100_000 + " automatically generated by y",)], "t string")
    assert [r[0] for r in df.select(h.has_notice(F.col("t"))).collect()] == [True, False, False, False, True]
