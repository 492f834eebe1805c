"""Alignment and languages on made corpora whose truth is known."""

import random

from vellum.llm import bilingual as B
from vellum.llm import languages as L

AGENT = {"商船": "thuyền buôn", "里民": "dân trong làng", "河官": "quan coi sông", "石工": "thợ đá", "倉官": "quan coi kho", "營兵": "lính trong doanh"}
VERB = {"買入": "mua vào", "修理": "sửa chữa", "封存": "niêm giữ", "運送": "chở", "查點": "kiểm điểm", "停收": "thôi thu"}
THING = {"水渠": "mương nước", "鹽稅": "thuế muối", "石橋": "cầu đá", "茶葉": "chè khô", "軍器": "khí giới", "麻繩": "dây gai"}


def sentence(rnd):
    a, v, t = (rnd.choice(list(d.items())) for d in (AGENT, VERB, THING))
    return a[0] + v[0] + t[0], f"{a[1]} {v[1]} {t[1]}"


def test_records(spark):
    rnd, rows, truth = random.Random(4), [], set()
    for i in range(700):
        pairs = [sentence(rnd) for _ in range(rnd.randrange(1, 5))]
        while len({h for h, _ in pairs}) < len(pairs):
            pairs = [sentence(rnd) for _ in pairs]
        order = list(range(len(pairs)))
        rnd.shuffle(order)
        drop = rnd.randrange(len(pairs)) if len(pairs) > 2 and rnd.random() < 0.3 else None
        han, ends, meaning, at = "", [], "", {}
        for h, _ in pairs:
            han += h + "。"
            ends.append(len(han) - 1)
        merge = rnd.random() < 0.3
        kept = [k for k in order if k != drop]
        parts, groups = [], []
        while kept:
            n = 2 if merge and len(kept) > 1 else 1
            groups.append(kept[:n])
            kept = kept[n:]
        for g in groups:
            meaning += (" " if meaning else "") + ", mà ".join(pairs[k][1] for k in g).capitalize() + "."
            for k in g:
                at[k] = len(meaning) - 1
        rows.append((i, han, meaning))
        truth |= {(i, ends[k], e) for k, e in at.items()}
    rows += rows[:2] + [(9000, None, "a."), (9001, "甲。", ""), (9002, "甲。", None)]
    df = spark.createDataFrame(rows, "row_id long, han string, meaning string")
    got = {(r.row_id, r.han_end, r.other_end) for r in B.record_pairs(df).collect()}
    right = len(got & truth)
    assert right / len(got) > 0.93 and right / len(truth) > 0.93


def long_tailed(seed=11, docs=2400, tail=220):
    """Records of two units, in half of them one of words that 0.3 % to 1 % of the records have; and the pairs, all and of such units."""
    rnd = random.Random(seed)
    syllable = lambda k: "".join((rnd_c[k % 20], rnd_v[k // 20 % 12], rnd_e[k // 240]))
    rnd_c, rnd_v, rnd_e = "b c d đ g h kh l m n ng nh ph r s t th tr v x".split(), "a ă â e ê i o ô ơ u ư y".split(), ["", "n", "m", "t"]
    word = lambda k: (chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k), f"{syllable(2 * k)} {syllable(2 * k + 1)}")
    rows, truth, rare = [], set(), set()
    for i in range(docs):
        units = [[rnd.randrange(40) for _ in range(3)], [40 + rnd.randrange(tail) for _ in range(3)] if i % 2 else [rnd.randrange(40) for _ in range(3)]]
        han = "".join("".join(word(k)[0] for k in u) + "。" for u in units)
        order = [1, 0] if rnd.random() < 0.5 else [0, 1]
        meaning, ends = "", {}
        for u in order:
            meaning += (" " if meaning else "") + " ".join(word(k)[1] for k in units[u]).capitalize() + "."
            ends[u] = len(meaning) - 1
        rows.append((i, han, meaning))
        pairs = [(i, 7 * u + 6, ends[u]) for u in (0, 1)]
        truth |= set(pairs)
        if i % 2:
            rare.add(pairs[1])
    return rows, truth, rare


def test_units_of_rare_words(spark):
    rows, truth, rare = long_tailed()
    df = spark.createDataFrame(rows, "row_id long, han string, meaning string")
    got = {(r.row_id, r.han_end, r.other_end) for r in B.record_pairs(df).collect()}
    assert len(got & rare) / len(rare) > 0.9 and len(got & truth) / len(got) > 0.9 and len(got & truth) / len(truth) > 0.9


def test_columns(spark):
    rnd, rows, truth, i = random.Random(7), [], set(), 0
    sound = {c: f"{chr(97 + k % 26)}{chr(97 + k // 26)}o" for k, c in enumerate(sorted({c for d in (AGENT, VERB, THING) for w in d for c in w}))}
    for page in range(150):
        texts = {sentence(rnd)[0] for _ in range(4)}
        cols = list(texts)
        reads = [[sound[c] for c in t] for t in cols]
        to = list(range(len(cols)))
        if page % 3 == 0:
            rnd.shuffle(to)
        if page % 5 == 0 and len(cols) > 1:  # two readings in one column
            reads[0], reads[1], to = reads[0] + reads[1], None, list(range(len(cols)))
            to[1] = 0
        ids = [i + k for k in range(len(cols))]
        i += len(cols)
        words = [None] * len(cols)
        for k, r in enumerate(reads):
            if r is not None:
                words[to[k]] = r
        for k in range(len(cols)):
            truth.add((ids[k], ids[to[k]]))
            rows.append((ids[k], f"X_001.001.{page:03d}.{k:02d}", k, list(cols[k]), words[k]))
    df = spark.createDataFrame(rows + rows[:3], "row_id long, sentence_id string, column_no int, sn_chars array<string>, qn_words array<string>")
    got = {(r.row_id, r.other_row_id) for r in B.column_pairs(df).collect()}
    assert len(got & truth) / len(got) > 0.95 and len(got & truth) / len(truth) > 0.95


ALIGNED = "row_id long, sentence_id string, column_no int, sn_chars array<string>, qn_words array<string>"


def test_long_page(spark, monkeypatch):
    """A page of 700 columns, the reading of each 600 places on, some of two columns in one; the same pairs as of the page in one step."""
    rnd, rows, truth = random.Random(5), [], set()
    text = lambda: [rnd.randrange(300) for _ in range(8)]
    han, read = (lambda t: [chr(0x4E00 + k) for k in t]), (lambda t: [f"{chr(97 + k % 25)}{chr(97 + k // 25)}o" for k in t])
    for i in range(1500):
        t = text()
        rows.append((i, f"X_001.001.{i // 5:03d}.{i % 5:02d}", i % 5, han(t), read(t)))
        truth.add((i, i))
    texts, words = [text() for _ in range(700)], [[] for _ in range(700)]
    for k, t in enumerate(texts):
        to = (k + 600 - (k % 7 == 1)) % 700
        words[to] += read(t)
        truth.add((5000 + k, 5000 + to))
    rows += [(5000 + k, f"X_001.002.001.{k:03d}", None, han(t), words[k] or None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ALIGNED)
    got = {(r.row_id, r.other_row_id) for r in B.column_pairs(df).collect()}
    assert len(got & truth) / len(got) > 0.95 and len(got & truth) / len(truth) > 0.95
    far = {p for p in truth if p[0] >= 5000}
    assert len(got & far) / len(far) > 0.95
    monkeypatch.setattr(B, "PAGE_COLUMNS", 10_000)
    assert {(r.row_id, r.other_row_id) for r in B.column_pairs(df).collect()} == got


def test_tiles_decide_as_one_step(spark, monkeypatch):
    rnd, rows = random.Random(8), []
    for i in range(600):
        t = sentence(rnd)[0] + sentence(rnd)[0][: rnd.randrange(1, 6)]
        rows.append((i, f"X_001.001.{i // 12:03d}.{i % 12:02d}", i % 12, list(t), [f"w{ord(c)}" for c in (t if rnd.random() < 0.7 else t[::-1])] if i % 9 else None))
    df = spark.createDataFrame(rows, ALIGNED)
    got = []
    for n in (512, 4):
        monkeypatch.setattr(B, "PAGE_COLUMNS", n)
        got.append(sorted((r.row_id, r.other_row_id) for r in B.column_pairs(df).collect()))
    assert got[0] == got[1] and len(got[0]) > 500


def test_empty_alignment(spark):
    rec = spark.createDataFrame([], "row_id long, han string, meaning string")
    al = spark.createDataFrame([], "row_id long, sentence_id string, column_no int, sn_chars array<string>, qn_words array<string>")
    assert B.found(rec, al).count() == 0


TEXTS = {
    "vi": ["Quan huyện xem xét nhận thuế muối.", "Lính trạm chở gạo về kho tàng.", "Thợ đá sửa chữa cầu đá ở bến."],
    "en": ["The scribe records the price of copper.", "This folio lists three boats of timber.", "A later hand corrects the date."],
    "fr": ["Le copiste mentionne deux colonnes de noms.", "La fiche compare la liste des foyers.", "Le registre omet le sceau manquant."],
    "lzh": ["河官修理石橋，水勢漸退。", "商船買入茶葉。", "里民停收鹽稅矣。"],
    "zh": ["目录提到了修河堤的费用。", "这张卡片更正了铜的价格。", "我们的转写确认了盐税的数目。"],
}
DOC = "doc_id long, text string, lang string, source string, doc_type string, seg_no int"


def test_languages(spark):
    rnd, rows, want, i = random.Random(3), [], set(), 0
    for _ in range(120):
        for lang, texts in TEXTS.items():
            i += 1
            rows.append((i, " ".join(rnd.choices(texts, k=3)), lang if rnd.random() < 0.9 else "vi", rnd.choice(["a", "b", None]), "note", 0))
            if rows[-1][2] != lang:
                want.add((i, 0, lang))
    extra = [
        (9001, "The scribe records the price of copper. A later hand corrects the date.", "EN-gb", "a", "note", 0), (9002, "河官修理石橋，水勢漸退。商船買入茶葉。", None, "a", "note", 0), (9003, "Thợ đá sửa chữa cầu đá ở bến (禮物). Lính trạm chở gạo.", " ", "a", "note", 0),
        (9004, "商船買入茶葉。里民停收鹽稅矣。 Quan huyện xem xét nhận thuế muối. Lính trạm chở gạo về kho tàng.\nLe registre omet le sceau manquant. La fiche compare la liste.", "zh", None, None, 0),
        (9005, None, "vi", "a", "n", 0), (9006, "", None, "a", "n", 0), (9007, " \t", None, "a", "n", 0), (9008, "12; 13; 14", None, "a", "n", 0), (9009, "目录提到了修河堤的费用。", "??", "a", "n", 0),
    ]
    want |= {(9002, 0, "lzh"), (9003, 0, "vi"), (9004, 1, "lzh"), (9004, 2, "vi"), (9004, 3, "fr"), (9009, 0, "zh")}
    got = {tuple(r) for r in L.found(spark.createDataFrame(rows + extra, DOC)).collect()}
    assert got == want
    s = L.segments(spark.createDataFrame(rows + extra, DOC)).where("doc_id = 9004").orderBy("seg_no").collect()
    assert all(0 < r.confidence <= 1 for r in s) and s[0].start == 0 and s[0].last < s[1].start


def test_no_documents(spark):
    assert L.found(spark.createDataFrame([], DOC)).count() == 0


def test_long_records_go_in_tiles(spark, monkeypatch):
    """Records with more pairs of units than one step takes are aligned in tiles, with the same result; repeated rows change nothing."""
    rnd, rows = random.Random(8), []
    for i in range(300):
        pairs = [sentence(rnd) for _ in range(rnd.randrange(1, 7))]
        rows.append((i, "".join(h + "。" for h, _ in pairs), " ".join(v.capitalize() + "." for _, v in rnd.sample(pairs, len(pairs)))))
    df = spark.createDataFrame(rows + rows[:5], "row_id long, han string, meaning string")
    want = {tuple(r) for r in B.record_pairs(df).collect()}
    for n in (1, 2, 4):
        monkeypatch.setattr(B, "PAGE_COLUMNS", n)
        assert {tuple(r) for r in B.record_pairs(df).collect()} == want
