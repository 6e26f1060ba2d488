from datetime import datetime

from graphloom.llm import codedoc as C
from tests.conftest import rows

DEF = "filepath string, kind string, path string, node string, text string, received_at timestamp, signature string"
T = datetime(2024, 1, 1)

MODULE = '''
class Box:
    async def open_lid(self, *, hard=False) -> int:
        """Lifts the heavy cover from every crate."""
        def inner(x):
            "tiny"
        return 1

    @property
    def name(self):
        """
        ---
        id_self: m
        title: Not this title with many words indeed
        brief: |
            Gives back what people call this crate.
        ...
        """

def plain(a, b=1, *c, **d): pass

def plain(a, b=2, *c, **d):
    \'\'\'Adds several unrelated numbers together somehow.\'\'\'

def repeat_word(): "repeat word repeat word repeat"
def f_string(): f"Adds several unrelated numbers together somehow."
if True:
    def guarded(): "Runs only under certain rare circumstances."
'''


def test_paths_and_documentation(frame):
    df = frame([("m.py", "module", "", MODULE, None, T, "s"), ("m.py", "module", "", MODULE, None, T, "s")], DEF)
    got = {r["path"]: r for r in C.code_pairs(df).collect()}
    assert set(got) == {"Box.open_lid", "Box.name", "plain", "guarded"}
    assert got["Box.name"]["documentation"] == "Gives back what people call this crate." and got["Box.name"]["code"].lstrip().startswith("@property")
    assert got["Box.open_lid"]["signature"] == "self,*,hard" and got["plain"]["signature"] == "a,b,*c,**d"


def test_declared_documentation_goes_first(frame):
    item = "id_self: x\nbrief: |\n    Takes seven steps toward the river.\nother: no"
    df = frame(
        [
            ("a.py", "function", "A.walk", "def walk(n):\n    '''Old words about some other thing.'''", item, T, ""),
            ("a.py", "module", "", "class A:\n    def walk(n): pass", None, T, ""),
            ("b.py", "function", "run", "def run():\n    '''Tells much about many other things.'''", "brief: n/a", T, ""),
            ("c.py", "class", "K", "class K:\n    def m(): 'Counts every bird above this lake.'", "brief: Class words only matter for classes here", T, ""),
            ("d.py", "function", "P.q.r", "def r():\n    def s(): 'Counts every bird above this lake.'", None, T, ""),
        ],
        DEF,
    )
    got = {(r["filepath"], r["path"]): r["documentation"] for r in C.code_pairs(df).collect()}
    assert got == {("a.py", "A.walk"): "Takes seven steps toward the river.", ("c.py", "K.m"): "Counts every bird above this lake.", ("d.py", "P.q.r.s"): "Counts every bird above this lake."}


SAYS = "Counts every bird above this lake."


def test_declarations_in_other_files(frame):
    stub = f"def fly(x: int) -> int:\n    '{SAYS}'\ndef fly(x: int, y: int) -> int:\n    'Counts two kinds of birds above lakes.'\nclass A:\n    def go(self): 'Walks around slowly until evening comes.'"
    source = "def fly(x=1): return x\nclass A:\n    def go(self): ...\n    def go(self, far): ...\ndef fly(z): 'Has words by itself which win here.'"
    df = frame([("stubs/p/m.pyi", "module", "", stub, None, T, ""), ("src/p/m.py", "module", "", source, None, T, ""), ("src/q/m.py", "module", "", source, None, T, ""), ("src/p/k/__init__.py", "module", "", "def fly(x): ...", None, T, "")], DEF)
    got = {(r["filepath"], r["path"], r["signature"]): (r["documentation"], r["declared_in"]) for r in C.code_pairs(df).collect()}
    own = ("Has words by itself which win here.", None)
    assert got == {
        ("src/p/m.py", "fly", "x"): (SAYS, "stubs/p/m.pyi"),
        ("src/p/m.py", "A.go", "self"): ("Walks around slowly until evening comes.", "stubs/p/m.pyi"),
        ("src/p/m.py", "fly", "z"): own,
        ("src/q/m.py", "fly", "z"): own,
    }


def test_two_overloads_are_two_rows(frame):
    df = frame([("m.py", "module", "", f"def f(a): '{SAYS}'\ndef f(a, b): '{SAYS}'", None, T, "")], DEF)
    assert sorted(r["signature"] for r in C.code_pairs(df).collect()) == ["a", "a,b"]


def test_a_pair_is_of_one_delivery(frame):
    old, new = "def f(a):\n    'Zebras counted every bird above this lake.'\n    return 1", f"def f(a):\n    '{SAYS}'\n    return 2"
    df = frame([("m.py", "module", "", old, None, T, ""), ("m.py", "module", "", new, None, datetime(2024, 2, 1), ""), ("m.py", "module", "", "def f(a): return 3", None, datetime(2024, 3, 1), "")], DEF)
    (r,) = C.code_pairs(df).collect()
    assert r["documentation"] == SAYS and r["code"].endswith("return 2")


def test_unusable_rows(frame):
    df = frame([("a.py", "module", "", "def (", None, T, ""), ("a.js", "module", "", "def f(): 'Counts every bird above this lake.'", None, T, ""), (None, None, None, None, None, None, None), ("n.py", "module", None, "x = '\0'", None, None, None), ("e.py", "module", "", "", None, T, "")], DEF)
    assert C.code_pairs(df).count() == 0 and C.code_pairs(df.limit(0)).count() == 0


def test_line_ends_and_long_source(frame):
    src = "def f():\r\n    '''Counts every bird\r\n    above this lake.'''\r\n" + "x = 1\r\n" * 20_000
    got = C.code_pairs(frame([("a.py", "module", "", src, None, T, "")], DEF)).collect()
    assert len(got) == 1 and "\r" not in got[0]["code"]


def test_data_values():
    assert C.data_values("brief:\ndescription: 'one line'\n") == {"description": "one line"}
    assert C.data_values("  brief: >-\n    a\n    b\n  x: y") == {"brief": "a\nb"}
    assert C.data_item("a\n --- \nbrief: x\n ...\nb") == "brief: x" and C.data_item("--- no") is None
    assert C.new_words("a_b", "a b a b c d e f") == 4 and C.new_words("a_b", "c d e f g A") == 5 and C.new_words("x", None) == 0
    assert C.module_name("src/a/b.py") == C.module_name("a-stubs/b.pyi") == "a.b" and C.module_name("a/__init__.py") == "a" and C.module_name("src.py") == "src"
