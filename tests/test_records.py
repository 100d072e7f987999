"""History, shredding, references and snapshot changes on small fixtures and against plain Python."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import history, references, shred, snapdiff
from tessella.operators.rows import latest
from tessella.operators.skew import heavy_keys, missing_from

SNAP = "id long, repo_name string, ts timestamp_ntz, commit_sha string, extra string"
MEMB = "snapshot_id long, file_path string, domain_name string, recorded_at timestamp_ntz, seq int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark, moment):
    snaps = [(3, "r", moment(5), None, "x"), (1, "r", moment(1), "a", "x"), (1, "r", moment(1), "a", "x"), (2, "r", moment(3), "b", None), (7, "r", moment(2), "c", None), (9, "q", moment(1), None, None)]
    memb = [
        (1, "./r\\a", " auth ", moment(1), 1), (1, "r/a", "CORE", moment(1, 5), 1), (1, "r/b", None, moment(1), None), (1, "r/b", None, moment(1), None),
        (2, "r/a", "core", moment(3), 1), (2, "r/b", "X", moment(3), 1), (3, "r/b", "x ", moment(5), 1), (3, "r/a", "CORE", moment(5), 2), (3, "r/c", "", moment(5), 1),
        (9, "q/a", None, moment(1), 1), (77, "r/z", "A", moment(1), 1), (1, None, "A", moment(1), 1), (None, "r/n", "A", moment(1), 1),
    ]
    return history.full_snapshots(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(memb, MEMB))


def test_versions(series):
    got = rows(history.merge(*series).select("file_path", "domain_name", "from_snapshot_id", "to_snapshot_id", "is_current"))
    assert got == sorted(
        [("q/a", None, 9, -1, True), ("r/a", "CORE", 1, -1, True), ("r/b", None, 1, 2, False), ("r/b", "X", 2, -1, True), ("r/c", "", 3, -1, True)], key=repr
    )


def test_absence_ends_a_version(spark, moment):
    snaps = spark.createDataFrame([(i, "r", moment(i), None, None) for i in range(1, 5)], SNAP)
    memb = spark.createDataFrame([(i, p, "A", moment(i), 0) for i, p in [(1, "x"), (2, "y"), (3, "x"), (4, "x"), (4, "y")]], MEMB)
    got = rows(history.merge(*history.full_snapshots(snaps, memb)).select("file_path", "from_snapshot_id", "to_snapshot_id"))
    assert got == [("x", 1, 2), ("x", 3, -1), ("y", 2, 3), ("y", 4, -1)]


def test_deliveries_are_settled_by_the_operators(spark, moment):
    snaps = spark.createDataFrame([(1, "r", moment(1), None, None), (2, "r", moment(2), None, None)], SNAP)
    memb = [(1, "p", "A", moment(1), 0), (1, "./p", "B ", moment(2), 0), (1, "p", "A", moment(1), 0), (2, "p", "b", None, 0), (2, "p", None, None, 0), (2, "q", None, moment(2), 0)]
    series, rows_ = history.delivered_snapshots(snaps, spark.createDataFrame(memb, MEMB))
    assert rows(history.merge(series, rows_).select("file_path", "domain_name", "from_snapshot_id", "to_snapshot_id")) == [("p", "B", 1, -1), ("q", None, 2, -1)]
    assert rows(snapdiff.changes(snapdiff.chunked(rows_, series), series).select("snapshot_id", "file_path", "change")) == [(2, "q", "added")]


def test_changes(series):
    chunks, states = series
    got = rows(snapdiff.changes(snapdiff.chunked(states, chunks, chunk_rows=2, blocks=3), chunks).select("snapshot_id", "file_path", "change"))
    assert got == [(2, "r/b", "changed"), (3, "r/c", "added")]


def test_empty_history(spark):
    e = history.full_snapshots(spark.createDataFrame([], SNAP), spark.createDataFrame([], MEMB))
    assert history.merge(*e).count() == 0
    assert snapdiff.changes(snapdiff.chunked(e[1], e[0]), e[0]).count() == 0


def test_merging_one_by_one_equals_one_pass(spark, moment):
    rnd = random.Random(5)
    state = {f"p{i}": rnd.choice("ABC") for i in range(30)}
    snaps, memb = [], []
    for s in range(1, 7):
        for p in rnd.sample(sorted(state), 8):
            if rnd.random() < 0.3:
                state.pop(p, None)
            else:
                state[p] = rnd.choice(["A", "B", None])
        state.setdefault(f"n{s}", "A")
        snaps.append((s, "r", moment(s), None, None))
        memb += [(s, p, d, moment(s), 0) for p, d in state.items()]
    series, states = history.full_snapshots(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(memb, MEMB))
    bulk = rows(history.merge(series, states))
    dim = history.merge(series.where("seq = 1"), states.where("snapshot_id = 1"))
    for s in range(2, 7):
        before = series.where(F.col("seq") == s - 1).select("repo_name", "seq")
        dim = history.merge(series.where(F.col("seq") <= s), states.where(F.col("snapshot_id") == s), dim, before)
        dim = spark.createDataFrame(dim.collect(), dim.schema)
    assert rows(dim) == bulk
    half = history.merge(series.where("seq <= 3"), states.where("snapshot_id <= 3"))
    assert rows(history.merge(series, states.where("snapshot_id > 3"), half, series.where("seq = 3"))) == bulk
    truth = Counter()
    at = defaultdict(dict)
    for i, p, d, *_ in memb:
        at[i][p] = d
    for s in range(2, 7):
        for p in at[s].keys() | at[s - 1].keys():
            k = "added" if p not in at[s - 1] else "removed" if p not in at[s] else "changed" if at[s][p] != at[s - 1][p] else None
            if k:
                truth[s, p, k] += 1
    got = Counter(map(tuple, snapdiff.changes(snapdiff.chunked(states, series, 4, 2), series).select("snapshot_id", "file_path", "change").collect()))
    assert got == truth


def walk_models(text):
    out = []

    def opened(v):
        while isinstance(v, str) and v.strip()[:1] in tuple('{["'):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def fields(v, path):
        v = opened(v)
        pairs = [(None, x) for x in v] if isinstance(v, list) else list(v.items()) if isinstance(v, dict) else []
        for key, x in pairs:
            if not isinstance(x, dict):
                continue
            name = x.get("name", key)
            line = path + [name] if name is not None else path
            if name is not None:
                out.append(">".join(line))
            fields(x.get("fields"), line)
            if isinstance(x.get("items"), dict):
                fields(x["items"].get("fields"), line)

    try:
        v = opened(json.loads(text))
    except (ValueError, TypeError):
        return out
    if isinstance(v, dict) and isinstance(v.get("fields"), list):
        v = v["fields"]
    fields(v, [])
    return out


def test_shredding_equals_a_plain_walk(spark, data):
    models = spark.read.parquet(f"{data}/models.parquet")
    truth = Counter((i, p) for i, t in {tuple(r) for r in models.select("id", "fields_json").collect()} for p in walk_models(t))
    got = Counter(map(tuple, shred.model_fields(models).select("record_id", "node_path").collect()))
    assert truth and got == truth


ODD = [
    None, "", "  ", "{bad", "null", "7", '"text"', "[]", "{}", '[{"name":"a"},{"type":"x"},5,[1],{"name":"a","fields":null}]',
    '{"items":{"type":"object","fields":[{"name":"x/y~z"}]},"fields":{"type":"t"},"a/b":{"fields":{"k":{"type":"u","items":{"fields":[{"name":"deep"}]}}}}}',
    '{"version":2,"fields":[{"name":"q","attrs":[{"name":"no"}],"items":{"fields":[{"name":"r","type":"[id]"}]}}]}', json.dumps(json.dumps([{"name": "twice", "fields": json.dumps([{"name": "in"}])}])),
    '[{"name":"NaN","default":NaN}]', "[" * 3000 + "]" * 3000, '{"name":"f","x":' * 1500 + "1" + "}" * 1500, '[{"name":"cut"',
]


def test_odd_json(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, '[{"name":"n"}]', "")], "id long, fields_json string, node string")
    got = Counter(map(tuple, shred.model_fields(df).select("record_id", "node_path").collect()))
    assert got == Counter(
        {(9, "a"): 2, (10, "items"): 1, (10, "items>x/y~z"): 1, (10, "fields"): 1, (10, "a/b"): 1, (10, "a/b>k"): 1, (10, "a/b>k>deep"): 1, (11, "q"): 1, (11, "q>r"): 1, (12, "twice"): 1, (12, "twice>in"): 1, (15, "f"): 1}
    )


def test_rejects_tell_why(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, fields_json string")
    nodes = shred.model_nodes(df)
    told = {r.record_id: r.reason for r in shred.rejects(nodes).collect()}
    assert sorted(told) == [2, 3, 13, 14, 16] and told[14] == "deeper than 2000 levels"
    assert nodes.where("record_id = 15 and kind = 'object'").count() == 1500


def test_parsing_without_the_call_stack():
    rnd = random.Random(1)

    def value(d):
        k = rnd.random()
        if d > 5 or k < 0.4:
            return rnd.choice([None, True, False, 1, -2.5e3, 'x\n"', ""])
        return [value(d + 1) for _ in range(rnd.randrange(4))] if k < 0.7 else {rnd.choice("abc") + str(i): value(d + 1) for i in range(rnd.randrange(4))}

    def read(parse, text):
        try:
            return repr(parse(text))
        except ValueError:
            return "no JSON"

    for _ in range(2000):
        text = json.dumps(value(0), indent=rnd.choice([None, 1]))
        j = rnd.randrange(len(text))
        for t in (text, text[:j], text[:j] + rnd.choice('{}[],:"x1') + text[j + 1 :]):
            assert read(shred._deep, t) == read(shred._DECODER.decode, t), t


def test_snapshot_domains(spark):
    texts = ['{"v":2,"summary":{"domains":[{"name":"A","owners":[{"name":"no"}],"languages":[{"name":"py"}]},{"name":"B"}]}}', '{"domains":{"C":{"languages":{"go":{"files":3}}}}}', '{"domains":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, summary_json string")
    assert rows(shred.snapshot_domains(df).select("record_id", "node_path")) == [(0, "A"), (0, "A>py"), (0, "B"), (1, "C"), (1, "C>go")]


def test_orphan_semantics(spark):
    refs = spark.createDataFrame([(1, 1, "a"), (2, 1, "z"), (3, None, "a"), (4, None, "z"), (5, 9, None), (6, None, None), (6, None, None), (7, 2, "a")], "i int, k long, p string")
    known = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "k long, p string, i int")
    keys = [("k", "k"), ("p", "p")]
    lost = lambda m: sorted(r.i for r in references.orphans(refs, known, keys, m).collect())
    assert lost("leading") == [4, 5]
    assert lost("partial") == [2, 4, 5, 7]
    assert lost("simple") == [2, 7]
    assert lost("full") == [2, 3, 4, 5, 7]
    none = known.limit(0)
    assert sorted(r.i for r in references.orphans(refs, none, keys, "leading").collect()) == [1, 2, 3, 4, 5, 7]
    assert references.orphans(refs.limit(0), known, keys).count() == 0
    with pytest.raises(ValueError):
        references.orphans(refs, known, keys, "guess")


def test_hot_keys_are_split(spark):
    df = spark.range(3000).select((F.when(F.col("id") < 1500, 5).when(F.col("id") < 2000, 6).otherwise(F.col("id"))).alias("k"), F.col("id").alias("row"))
    assert set(heavy_keys(df, "k")) == {5, 6}
    known = spark.createDataFrame([(6,), (2500,), (None,)], "k2 long")
    assert missing_from(df, "k", known, "k2").count() == 1500 + 999


def test_latest_is_whole_and_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (None, 1, "n")], "k int, t int, v string")
    assert rows(latest(df, ["k"], ["t"])) == [(1, 5, "b"), (None, 1, "n")]
