import numpy as np

from graphloom.llm import quality as Q

PROSE = "The man who lived by the river was not the one that we had seen. He went to the town and it was late when he came back to the house."
LIST = "- red apple\n- green pear\n- small plum\n- yellow melon\n- ripe fig"
TABLE = "| a | b | c |\n| --- | --- | --- |\n| 1.5 | x | 2024-01-01 |\n| 2.5 | y | 2024-01-02 |"
JUNK = "]{_<+#~ ^%$ @|\\/ *=}{ >>&& [~_ ]{_<+#~\n<div class=\"x-1\"></div><td class=\"y-2\"></td>"
DOC, LAB = "doc_id bigint, text string, label string", "doc_id bigint, label string"


def tables(frame):
    docs = [(1, PROSE, ""), (2, LIST, ""), (3, TABLE, ""), (4, JUNK, ""), (5, PROSE + "\n\n" + LIST, ""), (6, PROSE[:40] + "\n" + "\n".join([TABLE] * 4), ""), (7, None, ""), (8, " \n ", ""), (9, "word " * 50_000, ""), (1, PROSE, "")]
    return frame(docs, DOC), frame([(1, "prose"), (2, " List"), (3, "table"), (4, "junk"), (99, "prose"), (5, None), (None, "junk")], LAB)


def test_kinds(frame):
    d, lab = tables(frame)
    got = {r["doc_id"]: r for r in Q.label_shares(d, lab).collect()}
    assert [got[i]["kind"] for i in range(1, 9)] == ["prose", "list", "table", "junk", "prose", "table", None, None]
    assert got[9]["kind"] == "junk" and got[5]["list"] > 0.15 and abs(sum(got[5][k] for k in Q.LABELS) - 1) < 1e-6
    assert Q.label_shares(d, lab).count() == d.count()


def test_without_labels_and_empty(frame):
    d, lab = tables(frame)
    got = {r["doc_id"]: r["kind"] for r in Q.label_shares(d, lab.limit(0)).collect()}
    assert got[2] == "list" and got[3] == "table" and got[1] == "prose"
    assert Q.label_shares(d.limit(0), lab).count() == 0


def test_posterior_against_enumeration():
    rng = np.random.default_rng(0)
    m = Q.fit([])
    count = np.array([3, 0, 1, 4])
    e = np.log(rng.random((8, 4)))
    got = m.posterior(e, count)
    at = 0
    for c in count:
        if c:
            total = np.zeros((c, 4))
            for path in np.ndindex(*(4,) * c):
                p = m.start[path[0]] * np.exp(e[at, path[0]])
                for t in range(1, c):
                    p *= m.step[path[t - 1], path[t]] * np.exp(e[at + t, path[t]])
                for t in range(c):
                    total[t, path[t]] += p
            assert np.allclose(total / total.sum(1, keepdims=True), got[at : at + c])
        at += c


def test_held_out_lines():
    m = Q.fit([(PROSE, "prose"), (LIST, "list"), (TABLE, "table"), (JUNK, "junk")])
    held = {"Wenn der Mann nicht zu Hause ist, wartet er auf die Kinder und das Wetter.": "prose", "1. Blue stone\n2. Old bridge\n3. Wild horse": "list", "a,b,c\n1,2,3\n4,5,6\n7,n/a,9": "table", "buy! " * 30: "junk", "the\n" * 20: "junk"}
    for text, want in held.items():
        lines = Q.document_lines(text)
        p = m.posterior(m.emission(Q.line_features(lines, m.letter)), np.array([len(lines)]))
        assert Q.LABELS[int(p.sum(0).argmax())] == want, text


def test_statistics(frame):
    d, _ = tables(frame)
    got = {r["doc_id"]: r for r in Q.text_statistics(d).collect()}
    assert got[2]["bullet_share"] == 1 and got[1]["end_share"] == 1 and got[7]["n_word"] == 0 and got[7]["symbol_ratio"] is None and got[9]["n_word"] == 50_000
