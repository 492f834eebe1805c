"""Sentence units of texts in several scripts and punctuation habits, in SQL expressions.

Every step keeps the length of the text, so that positions in the masked text are positions in the stored value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scripts and habits.
TERMINATORS = "。．.○？！!?…"  # one character each
OPEN_CLOSE = (("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’"), ("«", "»"))
NOTES = (("(", ")"), ("（", "）"))
CLOSERS = "」』”\"’»)）\\]"
#: Characters that do not show may stand anywhere, also after a unit's last character, to which they then belong.
UNSEEN = "\\x{AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}"
#: Blanks other than the ordinary and the ideographic one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
#: Final particles of unpunctuated classical Chinese; 也者 marks a topic and 焉能 asks, both go on.
PARTICLES = ("也(?!者)", "矣", "焉(?!能)", "耳", "而已", "云爾", "謹奏", "欽此")
#: What may follow a quotation within its sentence.
AFTER_QUOTE = ("等因", "等語", "等情", "等由", "云云")
#: Words that end in a full stop which is no end when a small letter or number follows; titles also stand before names.
TITLES = "Dr|Mr|Mrs|Ms|St|MM|Mme|Mlle|Prof|ThS|TS|GS|PGS|Tp|TP"
ABBREVIATIONS = "T|tr|q|no|nos|cf|x|p|pp|vol|fol|ff|ch|art|Dr|Mr|Mrs|Ms|St|M|MM|Mme|Mlle|Prof|ed|eds|éd|trad|ms|mss|n|vv|Th|ThS|TS|GS|PGS|Tp|TP|Q|t|f|v|No|Fig|fig|etc|e|i|g|cap"

# Private-use placeholders: of decimals and abbreviations, in quotations, in notes; and the mark after a unit.
DOT, QUOTED, NOTED, END = "", "", "", ""


#: Parts of a text that are folded in one step.
BLOCK = 256


def _loose(word: str) -> str:
    """The pattern of a word with unseen characters allowed between its characters."""
    head = word.split("(")[0]
    return f"[{UNSEEN}]*".join(head) + word[len(head) :]


def let(value: Column, f) -> Column:
    """f(value) with one evaluation of ``value``, and one place in the plan, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _inside(s: Column, opening: str, closing: str, by: str) -> Column:
    """Replaces terminators and blanks between an opening mark and the last closing mark before the next opening."""
    what = TERMINATORS + " 　\n"
    to = by * len(what)

    def piece(x: Column, i: Column) -> Column:
        cut = F.length(x) - F.instr(F.reverse(x), closing) + 1
        return F.when((i > 0) & x.contains(closing), F.concat(F.translate(F.substr(x, F.lit(1), cut - 1), what, to), F.substr(x, cut))).otherwise(x)

    return let(s, lambda s: F.when(s.contains(opening), F.array_join(F.transform(F.split(s, f"\\Q{opening}\\E"), piece), opening)).otherwise(s))


def _straight(s: Column, by: str) -> Column:
    """The same between straight double quotation marks, which open and close in turn; an odd last one opens nothing."""
    what = TERMINATORS + " 　\n"
    to = by * len(what)

    def pieces(parts: Column) -> Column:
        inner = lambda i: (i % 2 == 1) & ((F.size(parts) % 2 == 1) | (i < F.size(parts) - 1))
        return F.array_join(F.transform(parts, lambda x, i: F.when(inner(i), F.translate(x, what, to)).otherwise(x)), '"')

    return let(s, lambda s: F.when(s.contains('"'), let(F.split(s, '"'), pieces)).otherwise(s))


def masked(text: Column) -> Column:
    """The text with decimals, URLs, abbreviations, quotations and notes masked; as long as the text."""
    s = F.regexp_replace(text, "[-]", "")  # placeholders of the text itself
    s = F.translate(s, "⽿⽽⼰" + BLANKS, "耳而已" + " " * len(BLANKS))
    s = F.regexp_replace(s, r"[.．](?<=[0-9０-９].)(?=[0-9０-９])", DOT)
    s = let(s, lambda s: F.when(s.contains("://"), F.regexp_replace(s, r"[.?!](?<=[A-Za-z0-9/_-].)(?=[A-Za-z0-9/_-])", DOT)).otherwise(s))
    # the stop comes first in the pattern, so that what is before it is looked at only there
    short = rf"\.(?<=(?<!\p{{L}})(?:{ABBREVIATIONS})\.)(?=\s?[\p{{Ll}}0-9(,;:])|\.(?<=(?<!\p{{L}})(?:{TITLES})\.)(?=\s?\p{{Lu}})|\.(?<=(?<!\p{{L}})\p{{Lu}}\.)(?=\s?\p{{Lu}})|\.(?<=(?<!\p{{L}})v\.)(?=v(?!\p{{L}}))|\.(?<=(?<!\p{{L}})v[{DOT}.]v\.)(?=\s*[,;:\p{{Ll}}])"
    s = let(s, lambda s: F.when(s.rlike(r"[\p{IsLatin}]\."), F.regexp_replace(s, short, DOT)).otherwise(s))
    for opening, closing in NOTES:
        s = _inside(s, opening, closing, NOTED)
    s = _inside(s, "[", "]", NOTED)
    for opening, closing in OPEN_CLOSE:
        s = _inside(s, opening, closing, QUOTED)
    return _straight(s, QUOTED)


_HAN = r"\x{2E80}-\x{2FDF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_AFTER = "|".join(map(_loose, AFTER_QUOTE))
#: A terminator of Latin script ends a unit only before a blank, Han text or the end.
_STOP = rf"""(?:[。．○？！]|[.!?…](?=[.!?…。．？！{CLOSERS}{UNSEEN}]*(?:\s|$|[{_HAN}「『“"«‘(（])))"""
_STOPS = rf"{_STOP}(?:[{TERMINATORS}{UNSEEN}])*[{CLOSERS}{UNSEEN}]*+(?!\s+\p{{Ll}}(?<![{_HAN}]))"
#: A quotation with its own terminator ends the unit where a new one begins.
_QUOTE = rf"""(?<={QUOTED})[」』”"’»]++[{UNSEEN}]*+(?:(?=\s*+[{_HAN}「『“"])(?!\s*+(?:{_AFTER}))|(?=\s++[\p{{Lu}}0-9])|(?=\s*+$))"""
_PARTICLE = "(?:" + "|".join(map(_loose, PARTICLES)) + f")[{UNSEEN}]*+(?!者)"
_BLANKS = rf"(?<![，、,：:；;奉\s])(?=[ \x{{3000}}\n]++(?!聖旨)(?![ \x{{3000}}\n]))"


def marked(text: Column) -> Column:
    """The masked text with END after each unit.

    A text that has terminators is split at them; one without at its final particles; one without either at its blanks
    and line breaks (the honorific blank before 聖旨 is none).
    """
    m = masked(text)

    def split(m: Column) -> Column:
        by_stop = F.regexp_replace(m, f"({_STOPS}|{_QUOTE})", f"$1{END}")
        by_particle = F.regexp_replace(m, f"({_PARTICLE}(?:{_PARTICLE})*)", f"$1{END}")
        by_blank = F.regexp_replace(m, _BLANKS, END)
        stop = m.rlike(f"[{TERMINATORS}{QUOTED}]")
        latin = m.rlike(r"[\p{IsLatin}]{3}") & ~m.rlike(f"[{_HAN}]")
        return F.when(stop | latin, by_stop).when(m.rlike(_PARTICLE), by_particle).otherwise(by_blank)

    return let(m, split)


def units(text: Column) -> Column:
    """ARRAY<STRUCT<start INT, last INT>> of the units of ``text``: code points from 0, blanks around a unit excluded.

    Null, empty and blank texts have no units (an empty array). The last unit ends with the text's last character that is no blank.
    """
    none = F.array().cast("array<struct<start:int,last:int>>")

    def spans(parts: Column, at: Column) -> Column:
        """The units of parts that begin at ``at``."""

        def step(a: Column, p: Column) -> Column:
            right = F.length(F.regexp_replace(p, r"[\s\x{3000}]+$", ""))
            left = F.length(p) - F.length(F.regexp_replace(p, r"^[\s\x{3000}]+", ""))
            one = F.struct((a["at"] + left).cast("int").alias("start"), (a["at"] + right - 1).cast("int").alias("last"))
            return F.struct((a["at"] + F.length(p)).alias("at"), F.when(right > 0, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

        return F.aggregate(parts, F.struct(at.cast("int").alias("at"), none.alias("out")), step, lambda a: a["out"])

    def blocks(parts: Column) -> Column:
        """The same by blocks of BLOCK parts, so that the work does not grow with the square of the parts."""
        ats = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), F.array(F.lit(0)), lambda a, k: F.concat(a, F.array((F.element_at(a, -1) + F.length(F.array_join(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)), ""))).cast("int"))))
        return F.flatten(F.transform(F.slice(ats, F.lit(1), F.size(ats) - 1), lambda at, k: spans(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)), at)))

    made = let(F.split(marked(text), END), lambda parts: F.when(F.size(parts) <= BLOCK, spans(parts, F.lit(0))).otherwise(blocks(parts)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(made)


def sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each unit: the columns ``keep``, unit_no from 1, start, last and unit (the text restored). One narrow pass."""
    x = df.select(*keep, F.col(text).cast("string").alias("_text"))
    x = x.select(*keep, "_text", F.posexplode(units(F.col("_text"))).alias("unit_no", "_u"))
    unit = F.substr(F.col("_text"), F.col("_u.start") + 1, F.col("_u.last") - F.col("_u.start") + 1)
    return x.select(*keep, (F.col("unit_no") + 1).alias("unit_no"), F.col("_u.start").alias("start"), F.col("_u.last").alias("last"), unit.alias("unit"))


def element_ends(elements: Column) -> Column:
    """The index of the element that holds the last character of each unit of the joined elements. Null elements are empty."""
    clean = F.transform(elements, lambda x: F.coalesce(x, F.lit("")))
    joined = F.array_join(clean, "")
    plain = F.forall(clean, lambda x: F.length(x) == 1)
    sums = F.aggregate(clean, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x)).cast("int"))))
    last = F.transform(units(joined), lambda u: u["last"])
    return let(last, lambda last: F.when(plain, last).otherwise(let(sums, lambda s: F.transform(last, lambda p: F.size(F.filter(s, lambda c: c <= p))))))


def ends(records: DataFrame, aligned: DataFrame) -> DataFrame:
    """(table_name, row_id, end_pos) of every sentence of records.han and aligned_sentences.sn_chars, each once.

    A narrow pass over two columns, then one shuffle of small rows that drops those of repeated row_ids.
    """
    a = records.select(F.lit("records").alias("table_name"), "row_id", F.explode(F.transform(units(F.col("han")), lambda u: u["last"])).alias("end_pos"))
    b = aligned.select(F.lit("aligned_sentences").alias("table_name"), "row_id", F.explode(element_ends(F.col("sn_chars"))).alias("end_pos"))
    return a.unionByName(b).distinct()
