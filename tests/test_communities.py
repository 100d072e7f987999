"""Communities by blocks, against the rule that no node can gain."""

from collections import defaultdict

from tessella.operators import domains as d


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id long")


def test_communities_of_several_blocks(spark, monkeypatch):
    cliques = [(c * 10 + a, c * 10 + b) for c in range(30) for a in range(6) for b in range(a)] + [(c * 10 + c % 6, (c * 7 + 3) % 30 * 10 + 1) for c in range(30)]
    chain = [(n, n + 1) for n in range(1000, 1120)]
    edges = [e for e in cliques + chain if e[0] != e[1]]
    names = sorted({n for e in edges for n in e})
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    written = []
    plain = d.materialize
    monkeypatch.setattr(d, "materialize", lambda df, label: written.append(label) or plain(df, label))
    for block, most in ((1 << 23, 10), (200, 400)):
        monkeypatch.setattr(d, "_BLOCK", block)
        written.clear()
        of = {r.id: r.community for r in d.communities(ids(spark, *names), spark.createDataFrame(edges, "src long, dst long"), 0.05).collect()}
        assert len(written) < most and set(of) == set(names)
        parts = defaultdict(set)
        for n, c in of.items():
            parts[c].add(n)
        gain = lambda n, c: len(near[n] & parts[c]) - 0.05 * (len(parts[c]) - (of[n] == c))
        assert not [n for n in of if max(gain(n, of[m]) for m in near[n]) > max(0, gain(n, of[n])) + 1e-6]
        for c, members in parts.items():
            seen = front = {c}
            while front:
                front = {m for n in front for m in near[n] & members} - seen
                seen = seen | front
            assert seen == members and c == min(members)
