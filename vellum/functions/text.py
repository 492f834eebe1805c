"""Text functions: a column in, a column out, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of characters, as classes of Java patterns.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
CJK_BASIC = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{300}-\x{36F}"
GARBAGE = "#{}[]*&%~^<>|\\@=+"
VOWELS = "aàáảãạăắằẳẵặâấầẩẫậeèéẻẽẹêếềểễệiìíỉĩịoòóỏõọôốồổỗộơớờởỡợuùúủũụưứừửữựyỳýỷỹỵ"
FINGERPRINT = ("TRÍCH YẾU", "Loại:", "Xuất xứ", "Đề tài", "Để tài", "Công Đồng truyền", "Công đồng truyền", "Tờ/Tập", "Ngày:")
LABELS = (("Tờ/Tập:", "to_tap"), ("Tờ/ Tập:", "to_tap"), ("TờITập:", "to_tap"), ("Xuất xứ:", "xuat_xu"), ("Xuấtxứ:", "xuat_xu"), ("Đề tài:", "de_tai"), ("Để tài:", "de_tai"), ("Ngày:", "ngay"))
# Phrases of archive pages as scanned without accents, and as printed, in the order they apply.
PHRASES = (
    (r"\bCUC\s*VAN\s*THU\s*VA\s*LUU\s*TRU\s*NHA\s*NUOC\b", "CỤC VĂN THƯ VÀ LƯU TRỮ NHÀ NƯỚC"),
    (r"\bCUC\s*V[ÊE]?N?\s*THU\b", "CỤC VĂN THƯ"),
    (r"\bLUU\s*TR[ƯU]?\s*NH[AÀ]\s*NUC\b", "LƯU TRỮ NHÀ NƯỚC"),
    (r"\bLUUTRU[VWＮ]?\s*Ｎ?\b", "LƯU TRỮ NHÀ NƯỚC"),
    (r"\bHUCLUHC\b|\bHUC\s*LUHC\b|\bMUCLUC\b", "MỤC LỤC"),
    (r"\bCHAUBAN\s*TRIEU\s*NGUYEN\b|\bCHAUBANTRIEUNGUYEN\b", "CHÂU BẢN TRIỀU NGUYỄN"),
    (r"\bCH[AÂ]U\s*B[AẢ]?N?\b", "CHÂU BẢN"),
    (r"\bTRIU\s*NGUY[EÊỄ]N\b|\bTRI[EÊ]U\s*NGUY[EÊỄ]N\b", "TRIỀU NGUYỄN"),
    (r"\bTAPI\b|\bTAP\s*I\b", "TẬP I"),
    (r"\bT[AÂ]P\s*1\b", "TẬP 1"),
    (r"\bGIALONG\b", "GIA LONG"),
    (r"\bMINH\s*MENHI\b", "MINH MỆNH I"),
    (r"\bMINH\s*MENHV\b", "MINH MỆNH V"),
    (r"MINH1MNH", "MINH MỆNH"),
    (r"\bMINH\s*M[EÊ]NH\b", "MINH MỆNH"),
    (r"\bNH[AÀ]\s*XU[AẤ]T\s*B[AẢ]N\b", "NHÀ XUẤT BẢN"),
    (r"\bVN\s*HO\b", "VĂN HOÁ"),
    (r"\bV[AĂ]N\s*HO[AÁ]\b", "VĂN HOÁ"),
    (r"\bTH[OÔ]NG\s*TIN\b", "THÔNG TIN"),
    (r"\bXU[AẤ]T\s*B[AẢ]N\b", "XUẤT BẢN"),
)
# Patterns of catalogue pages.
DATE_LINE = r"(?iuU)^\s*\d{1,3}\s+tháng\b.*\bnăm\b"
DATE_ANCHOR = r"(?iuU)^\s*(?:Ngày\s*[:：]?\s*)?\d{1,3}\s+tháng\b.*\bnăm\b"
DATE_AFTER_NUMBER = r"(?iuU)^\d{1,4}\s+(tháng|năm|nhuận)\b"
DAY_PREFIX = r"(?iuU)^\s*Ngày\s*[:：]?\s*"
ENTRY_NUMBER = r"(?U)^(\d{1,4})\.?$"
KIND = r"(?iuU)Loại\s*[:：]\s*(.+?)(?:\s+(?:Xuất|Xuấtxứ|Đề|Để|Tờ|TờI|Công|Ngày)\b|$)"
LEAD_IN = r"(?iuU)^(Chiếu|Chỉ\s*[Dd]ụ|Dụ|Sử|Tư|Truyền|Sai|Tấu|Phụng|Phê|Tư\s*di|Công\s*[đĐ]ồng\s+\S+)\s*[:：]"
HEADING = r"(?iuU)^TRÍCH YẾU|^Công\s*[đĐ]ồng\b[^:：]*[:：]\s*$"
NUMBER_KIND = r"(?iuU)(\d{1,4})\s+Loại\s*[:：]"
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def characters(c: Column) -> Column:
    """Code points of a text; an empty array for the empty text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(c, ""), lambda x: x != ""))


def _share(c: Column, pattern: str) -> Column:
    n = F.length(compact(c))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(compact(c), f"[^{pattern}]", "")) / n)


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]$")


def cjk_ratio(c: Column) -> Column:
    """Share of Han characters among those that are no blanks; 0 where there are none."""
    return _share(c, CJK)


def script_ratios(c: Column) -> Column:
    """STRUCT<cjk, latin>: Han without extension B, Latin with combining marks."""
    return F.struct(_share(c, CJK_BASIC).alias("cjk"), _share(c, LATIN).alias("latin"))


def looks_latin(c: Column) -> Column:
    return (F.length(compact(c)) > 0) & (_share(c, "A-Za-z0-9") >= 0.6)


def fix_phrases(c: Column) -> Column:
    """Archive phrases as printed; runs of blanks made one."""
    for pattern, by in PHRASES:
        c = F.regexp_replace(c, f"(?iuU){pattern}", by)
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def fix_page(c: Column) -> Column:
    """``fix_phrases`` for each line; lines that are empty then are dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\R"), fix_phrases), lambda x: x != ""), "\n")


def fix_blocks(blocks: Column) -> Column:
    """Blocks with ``fix_phrases`` for those of the Latin pass or in Latin letters."""
    source = lambda b: F.lower(F.coalesce(b["source"], F.lit("")))
    text = lambda b: F.coalesce(b["text"], F.lit(""))
    return F.transform(blocks, lambda b: b.withField("text", F.when((source(b) == "latin") | looks_latin(text(b)), fix_phrases(text(b))).otherwise(text(b))))


def fix_text_or_blocks(text: Column, blocks: Column) -> Column:
    """``fix_page``; where nothing is left of the text, the texts of the fixed blocks that are not blank, a line each."""
    lines = F.filter(F.transform(fix_blocks(blocks), lambda b: b["text"]), lambda t: strip(t) != "")
    fixed = fix_page(F.coalesce(text, F.lit("")))
    return F.when(strip(fixed) != "", fixed).otherwise(F.coalesce(F.array_join(lines, "\n"), F.lit("")))


def label_of(c: Column) -> Column:
    """The field that a line's label names, or null."""
    out = None
    for text, name in LABELS:
        out = F.when(c.startswith(text), name) if out is None else out.when(c.startswith(text), name)
    return out


def label_value(c: Column) -> Column:
    out = None
    for text, _ in LABELS:
        v = strip(F.substr(c, F.lit(len(text) + 1)))
        out = F.when(c.startswith(text), v) if out is None else out.when(c.startswith(text), v)
    return out


def is_heading(c: Column) -> Column:
    return c.rlike(HEADING)


def kind_of_entry(c: Column) -> Column:
    """The value after Loại:, up to the next label; null where there is none."""
    return F.nullif(strip(F.regexp_extract(c, KIND, 1)), F.lit(""))


def entry_number(lines: Column, hint: Column) -> Column:
    """A given number; else the first 1 to 4 digits before Loại in the first line that has it, null if that names a folio;
    where no line has it, the number right before Loại: in all lines together."""
    with_kind = F.filter(lines, lambda x: x.rlike("Lo[aạáàảãăắằ]i"))
    before = F.regexp_extract(F.try_element_at(with_kind, F.lit(1)), "(?s)^(.*?)Lo[aạáàảãăắằ]i", 1)
    number = F.nullif(F.regexp_extract(before, r"(\d{1,4})", 1), F.lit("")).try_cast("int")
    whole = F.nullif(F.regexp_extract(F.array_join(lines, " "), NUMBER_KIND, 1), F.lit("")).try_cast("int")
    return F.coalesce(hint, F.when(F.size(with_kind) > 0, F.when(~before.rlike(r"(?U)Tờ|Tập|/\s*\d"), number)).otherwise(whole))


def is_garbage(c: Column) -> Column:
    """Blank, or with one of the signs of mangled Han text."""
    return (strip(c) == "") | (F.translate(c, GARBAGE, "") != c)


def is_noise(c: Column, watermark: str | None = None) -> Column:
    """Blank, a watermark, or one to three letters and digits of which there are both."""
    t = strip(c)
    found = (t == "") | (t.rlike(r"^[\dA-Za-zÀ-ỹ]{1,3}$") & t.rlike(r"\d") & t.rlike("[A-Za-zÀ-ỹ]"))
    return found | t.rlike(watermark) if watermark else found


def is_vietnamese_word(c: Column) -> Column:
    """At least two letters, one of them a vowel."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & F.lower(letters).rlike(f"[{VOWELS}]")


def kind_of_input(path: Column) -> Column:
    """pdf or image by the ending of a file's name; null where it is neither."""
    end = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]*)$", 1))
    return F.when(end == ".pdf", "pdf").when(end.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"), "image")


def is_three_block(source: Column) -> Column:
    """Whether a source's name asks for pages of three bands."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return low.contains("uctrai") | low.contains("ức trai") | low.contains("uc trai")


def page_targets(pages: Column, targets: Column) -> Column:
    """A map from pages (a list like 3,1; sorted and once each) to their targets, by place; null where no targets are given; an error where
    there are not as many."""
    numbers = lambda c: F.transform(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int"))
    a, b = F.array_sort(F.array_distinct(numbers(pages))), numbers(F.coalesce(targets, F.lit("")))
    return F.when(F.size(b) > 0, F.when(F.size(a) == F.size(b), F.map_from_arrays(a, b)).otherwise(F.raise_error(F.lit("pages and targets differ in number")).cast("map<int,int>")))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true", "yes", "on")


def refinable(enabled: bool, error: Column, page: Column, most: int = 10) -> Column:
    """Whether a page's text goes to the refiner: an early page that was read without an error."""
    return F.lit(enabled) & (F.coalesce(error, F.lit("")) == "") & (page <= most)


def has_fingerprint(c: Column) -> Column:
    """Whether at least two entries of the list of labels occur, without regard to case."""
    return F.size(F.filter(F.array(*map(F.lit, FINGERPRINT)), lambda k: F.lower(c).contains(F.lower(k)))) >= 2


def safe_stem(path: Column) -> Column:
    """The file name without its ending, in safe ASCII, 80 characters at most, else page."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(base, "[^A-Za-z0-9_.-]", "_"), 1, 80), F.lit("")), F.lit("page"))


def source_of_file(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    low = F.lower(name)
    return F.when(low.contains("chau") | low.contains("châu"), "ChauBan").when(low.contains("uctrai") | low.contains("uc_trai"), "UcTraiTap").when(name == "", "Unknown").otherwise(name)


def sentence_id(chapter: Column, page: Column, sentence: Column, prefix: str = "HVH_004") -> Column:
    """PREFIX.ccc.ppp.ss; an error outside 1 to 999, 1 to 999 and 1 to 99."""
    made = F.format_string(f"{prefix}.%03d.%03d.%02d", chapter, page, sentence)
    ok = chapter.between(1, 999) & page.between(1, 999) & sentence.between(1, 99)
    return F.when(ok, made).otherwise(F.raise_error(F.lit("chapter, page or sentence out of range")).cast("string"))


def parse_sentence_id(c: Column) -> Column:
    """STRUCT<prefix, chapter, page, sentence>, null where the text is no such id."""
    p = r"^([A-Z]{3}_\d{3})\.(\d{3})\.(\d{3})\.(\d{2})$"
    part = lambda i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(p), F.struct(part(1).alias("prefix"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("page"), part(4).cast("int").alias("sentence")))


def page_filter(text: Column) -> Column:
    """The pages that a list like 1,3,5-8 names, sorted and once each; null for no filter; an error where a range ends before it starts."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")

    def pages(x: Column) -> Column:
        lo = F.trim(F.element_at(F.split(x, "-"), 1)).cast("int")
        hi = F.trim(F.element_at(F.split(x, "-"), -1)).cast("int")
        return F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.raise_error(F.lit("a page range ends before it starts")).cast("array<int>"))

    return F.when(F.size(parts) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages)))))


def page_suffix(pages: Column) -> Column:
    """_pA-B for contiguous pages, else _p and the pages joined by -; nothing without a filter."""
    run = (F.array_max(pages) - F.array_min(pages) + 1 == F.size(pages)) & (F.size(pages) >= 2)
    many = F.concat(F.lit("_p"), F.array_join(F.transform(pages, lambda p: p.cast("string")), "-"))
    return F.when(pages.isNull() | (F.size(pages) == 0), "").when(run, F.concat(F.lit("_p"), F.array_min(pages).cast("string"), F.lit("-"), F.array_max(pages).cast("string"))).otherwise(many)


def retry_delay(message: Column) -> Column:
    """Seconds that an error text asks to wait, or null."""
    a = F.nullif(F.regexp_extract(message, r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s", 1), F.lit(""))
    b = F.nullif(F.regexp_extract(message, r"seconds:\s*(\d+)", 1), F.lit(""))
    return F.coalesce(a, b).try_cast("double")


def batch_state(raw: Column) -> Column:
    up, out = F.upper(F.coalesce(raw, F.lit(""))), None
    for tag in ("SUCCEEDED", "FAILED", "CANCELLED", "EXPIRED", "RUNNING", "PENDING"):
        out = F.when(up.contains(tag), tag.lower()) if out is None else out.when(up.contains(tag), tag.lower())
    return out.otherwise("unknown")


def passage(text: Column, prefix: str = "passage: ") -> Column:
    t = strip(text)
    return F.when((t != "") & ~t.startswith("passage:") & ~t.startswith("query:"), F.concat(F.lit(prefix), t)).otherwise(t)


def status_label(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.8, "Good").when(accuracy >= 0.5, "Partial").otherwise("Poor")


def volume_id(html: Column) -> Column:
    """The volume's identifier: from image addresses, from tags' texts, from all text; lower case, null where there is none."""
    a = F.regexp_extract(html, r"(?i)/site_media/nom/([a-z0-9\-]+)/jpeg/", 1)
    b = F.regexp_extract(html, r"(?s)<(?:b|strong|td|span|h2|h3)\b[^>]*>[^<]*?\b([A-Z]{2,10}-\d{3,6})\b", 1)
    d = F.regexp_extract(html, r"\b(NLVNPF-\d{4}|R\.\d{4}|[A-Z]{2,}-\d{3,})\b", 1)
    return F.lower(F.coalesce(*(F.nullif(x, F.lit("")) for x in (a, b, d))))


def page_count(html: Column) -> Column:
    """The number of pages a landing page states: from its list, its text, or its highest link; from 2 to 9,999."""
    ok = lambda x: F.when((x > 1) & (x < 10000), x)
    listed = F.regexp_extract(html, r"(?is)<dt[^>]*>\s*pages\s*</dt>\s*<dd[^>]*>[^<\d]*(\d+)", 1).try_cast("int")
    bold = F.regexp_extract(html, r"(?is)<(?:b|strong)[^>]*>[^<]*pages[^<]*</(?:b|strong)>\s*(?:</[a-z0-9]+>\s*)?<[^>]+>[^<\d]*(\d+)", 1).try_cast("int")
    texts = []
    for p in (r"(?i)(\d+)\s+pages?", r"(?i)Page\s+\d+\s+of\s+(\d+)", r"(?i)<b>Pages</b>[^<]*<[^>]+>(\d+)", r"(?i)Pages.*?(\d{2,4})"):
        numbers = F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), lambda x: x.try_cast("int"))
        texts.append(F.try_element_at(F.filter(numbers, lambda x: (x > 1) & (x < 10000)), F.lit(1)))
    links = F.array_max(F.transform(F.regexp_extract_all(html, F.lit("(?i)href=[\"']page/(\\d+)[\"']"), F.lit(1)), lambda x: x.try_cast("int")))
    return F.coalesce(ok(listed), ok(bold), *texts, F.when(links > 1, links))


def page_address(base: Column, volume: Column, page: Column) -> Column:
    return F.format_string("%s/site_media/nom/%s/jpeg/%s-%03d.jpg", base, volume, volume, page)
