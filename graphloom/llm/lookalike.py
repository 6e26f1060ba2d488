"""Visually identical text brought to one form."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pairs import within
from graphloom.session import written

# Letters of other scripts and the Latin letter or sign that looks the same.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜавеѕіјкмнорстухүһԁԛԝӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXYGQWaвesijкмнopcтyxyhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυγϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXaiκvopuycj"
ARMENIAN = "ԼՍՕհյոսցօ"
ARMENIAN_LATIN = "LUOhjnugo"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_LATIN = "DRTAJEWMHGZRWSVSLCPKdGB"
ROMAN = "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
ROMAN_LATIN = "IVXLCDMivxlcdm"
SMALL_CAPITAL = "ᴄᴏᴠᴡᴢꜱ"
SMALL_CAPITAL_LATIN = "covwzs"
SIGN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "‐": "-", "‑": "-", "−": "-", "∶": ":"}
LIGATURE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Invisible beside the format characters: fillers, joiners and variation selectors.
FILLER = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


@cache
def tables() -> tuple[str, str, str]:
    """(from, to, dropped): characters with their look-alike, one to one, and invisible ones.

    Built by rule over all of Unicode: full-width and half-width forms and
    font variants by their compatibility mapping, letters of other scripts
    by the tables above, and accented ones by their base letter with its
    marks kept.
    """
    base = {a: b for a, b in zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + ROMAN + SMALL_CAPITAL, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN + ROMAN_LATIN + SMALL_CAPITAL_LATIN) if a != b} | SIGN
    source, target, dropped = [], [], []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if c.isspace():
            continue
        if kind in ("Cf", "Cc") or c in FILLER or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            dropped.append(c)
            continue
        to = base.get(c)
        if to is None:
            mapping = unicodedata.decomposition(c)
            if mapping.startswith(("<wide>", "<narrow>", "<font>")):
                to = unicodedata.normalize("NFKC", c)
                to = base.get(to, to)
            elif mapping and not mapping.startswith("<"):
                parts = unicodedata.normalize("NFD", c)
                if parts[0] in base:
                    to = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
        if to is not None and len(to) == 1 and to != c:
            source.append(c)
            target.append(to)
    dropped += [chr(c) for c in [*range(9), *range(14, 28), 127]]
    return "".join(source), "".join(target), "".join(dropped)


def looks(c: Column | str) -> Column:
    """The text with look-alikes mapped, invisible characters dropped and white space folded.

    Case, accents, super- and subscripts and other visible marks stay. Null
    stays null; a text of white space only becomes empty.
    """
    source, target, dropped = tables()
    c = F.col(c) if isinstance(c, str) else c
    c = F.translate(c, source + dropped, target)
    for one, many in LIGATURE.items():
        c = F.replace(c, F.lit(one), F.lit(many))
    return F.trim(F.regexp_replace(c, r"(?U)[\s\u0085\u001c-\u001f]+", " "))


def _classes(rows: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (h1, h2, id) of every row with a text, and (h1, h2, class, canonical, n) of every distinct text.

    ``n`` is the number of distinct texts in the class. Equal texts are one
    row before they are mapped, and equal mapped forms one before they are
    collated, so a text with many copies costs a row a task and collation
    sees each form once. Texts are known by 128 bits of hash from there on.
    """
    source = rows.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")]
    member = source.select(*key, "id")
    distinct = source.groupBy("text").agg(F.min("id").alias("id"))
    mapped = written(distinct.select(*key, "text", "id", looks("text").alias("form")))
    forms = mapped.groupBy("form").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
    seen = forms.select("form", F.collate("form", "UNICODE").alias("seen"), "id", "text", "n")
    classes = seen.groupBy("seen").agg(F.min("id").alias("class"), F.min("text").alias("canonical"), F.sum("n").alias("n"))
    known = seen.select("form", "seen").join(classes, "seen").select("form", "class", "canonical", "n")
    return member, written(mapped.join(known, "form").select("h1", "h2", "class", "canonical", "n"))


def canonical(rows: DataFrame, text: str = "content", id: str = "obs_id") -> DataFrame:
    """(id, text, class, canonical) for every row with a text.

    Mapped texts are grouped under an accent- and case-sensitive Unicode
    collation, in which composed and combining accents are equal; of each
    class the least text in binary order is the canonical member, and
    ``class`` is the least id. Both are joined back to every row. Null
    texts have no class and are left out.
    """
    _, form = _classes(rows, text, id)
    source = rows.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    return source.join(form, ["h1", "h2"]).select("id", "text", "class", "canonical")


def look_pairs(rows: DataFrame, text: str = "content", id: str = "obs_id", expand: int | None = None) -> DataFrame:
    """(a, b) of rows whose texts look the same though their characters differ.

    Rows with equal characters are no pair. Every pair is given; with
    ``expand`` the copies in larger classes are a star (see ``within``).
    Classes of one text are left out before rows are joined to theirs.
    """
    member, form = _classes(rows, text, id)
    several = form.where("n > 1").select("h1", "h2", "class")
    mine = written(member.join(several, ["h1", "h2"]).select("class", F.col("h1").alias("variant"), "id"))
    return within(mine, True, expand)
