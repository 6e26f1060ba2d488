from graphloom.llm.lookalike import canonical, look_pairs, tables
from tests.conftest import rows

OBS = "obs_id bigint, content string, text string, class string"

SAME = ["Café au lait", "Cafe\u0301 au lait", "Ｃafé au\u00a0lait", "Саfé аu lаit", "  Café\u2003au\n lait\u200b ", "Ca\u00adfé au lait\ufeff"]
OTHER = ["Cafe au lait", "café au lait", "Café  au  lait²", "Café au lait2", "Café au lait ①", "Café au lait 1", "Cafê au lait", ""]


def test_same_and_different(frame):
    data = [(i, t, "", "") for i, t in enumerate(SAME + OTHER)]
    got = rows(look_pairs(frame(data, OBS)))
    n = len(SAME)
    assert got == sorted((a, b) for a in range(n) for b in range(a + 1, n))


def test_equal_characters_are_no_pair(frame):
    data = [(1, "a b", "", ""), (2, "a b", "", ""), (3, "a  b", "", ""), (4, None, "", ""), (5, None, "", ""), (6, " ", "", ""), (7, "\u200b", "", "")]
    assert rows(look_pairs(frame(data, OBS))) == [(1, 3), (2, 3), (6, 7)]


def test_canonical_member(frame):
    c = {r["id"]: (r["class"], r["canonical"]) for r in canonical(frame([(9, "ﬁne", "", ""), (2, "fine", "", ""), (3, "fіne", "", "")], OBS)).collect()}
    assert len(set(c.values())) == 1 and c[9] == (2, "fine")


def test_empty_long_and_star(frame):
    assert look_pairs(frame([], OBS)).count() == 0
    long = "x y " * 50_000
    data = [(i, long if i % 2 else long + " ", "", "") for i in range(6)]
    assert look_pairs(frame(data, OBS)).count() == 9
    assert look_pairs(frame(data, OBS), expand=3).count() == 5


def test_a_hot_text_costs_no_pair(frame):
    texts = ["a b"] * 201 + ["a  b"] * 3 + ["a b "] * 2 + [" a b"]
    got = rows(look_pairs(frame([(i, t, "", "") for i, t in enumerate(texts)], OBS)))
    assert got == sorted(((a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] != texts[b]), key=repr)


def test_letters_of_other_scripts(frame):
    pairs = [("Ꮪсale Ⅿ", "Scale M"), ("hօpe ոօw", "hope now"), ("ⅽᴏꜱt", "cost"), ("plain", "plaın")]
    got = rows(look_pairs(frame([(2 * i + k, t, "", "") for i, p in enumerate(pairs) for k, t in enumerate(p)], OBS)))
    assert got == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_table_is_one_to_one():
    from graphloom.llm import lookalike as L

    assert all(len(getattr(L, k)) == len(getattr(L, f"{k}_LATIN")) for k in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "ROMAN", "SMALL_CAPITAL"))
    a, b, _ = tables()
    assert len(a) == len(b) == len(set(a)) and not set(a) & {chr(i) for i in range(128)}
