"""Bodies of statutes in XML as provision rows, and lines of zipped word-processor files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element names of statute bodies and paragraph signs (fixed values).
ITEM = "struct<`호번호`:string,`호내용`:string>"
PARAGRAPH = f"struct<`항번호`:string,`항내용`:string,`호`:array<{ITEM}>>"
ARTICLE = f"struct<`조문여부`:string,`조문번호`:string,`조문가지번호`:string,`조문제목`:string,`조문내용`:string,`항`:array<{PARAGRAPH}>>"
SUPPLEMENT = "struct<`부칙공포일자`:string,`부칙내용`:string>"
BODY = f"struct<`조문`:struct<`조문단위`:array<{ARTICLE}>>,`부칙`:struct<`부칙단위`:array<{SUPPLEMENT}>>>"
PREAMBLE = "전문"
ROUND_NUMBERS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
HEAD = "^제[0-9]+조(?:의[0-9]+)?(?:\\([^()]*\\))?"
ITEM_NUMBER = "^\\s*([0-9]+)(?:의([0-9]+))?\\."
ROW = "array<struct<path:string,unit:string,heading:string,text:string>>"


def _plain(text: Column, marker: str = "^") -> Column:
    """Blanks single, the leading marker taken off."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \n\t")), marker, ""), "\\s+", " "))


def _row(path: Column, unit: str, text: Column, heading: Column | None = None) -> Column:
    return F.struct(path.alias("path"), F.lit(unit).alias("unit"), (F.lit(None).cast("string") if heading is None else heading).alias("heading"), text.alias("text"))


def _branch(number: Column) -> Column:
    return F.when(number.isNotNull() & ~number.isin("", "0"), F.concat(F.lit("-"), number)).otherwise("")


def _items(parent: Column, items: Column) -> Column:
    def row(x: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(x["호내용"], ITEM_NUMBER, 1), F.lit("")), F.regexp_extract(x["호번호"], "([0-9]+)", 1))
        return _row(F.concat(parent, F.lit(".i"), number, _branch(F.regexp_extract(x["호내용"], ITEM_NUMBER, 2))), "item", _plain(x["호내용"], ITEM_NUMBER))

    return F.transform(F.coalesce(items, F.array().cast(f"array<{ITEM}>")), row)


def _paragraphs(article: Column, paragraphs: Column) -> Column:
    def rows(x: Column) -> Column:
        sign = F.substring(F.btrim(x["항번호"]), 1, 1)
        numbered = F.coalesce(F.char_length(sign) > 0, F.lit(False))
        path = F.when(numbered, F.concat(article, F.lit(".p"), F.position(sign, F.lit(ROUND_NUMBERS)).cast("string"))).otherwise(article)
        own = F.when(numbered, F.array(_row(path, "paragraph", _plain(x["항내용"], f"^[{ROUND_NUMBERS}]")))).otherwise(F.array().cast(ROW))
        return F.concat(own, _items(path, x["호"]))

    return F.flatten(F.transform(F.coalesce(paragraphs, F.array().cast(f"array<{PARAGRAPH}>")), rows))


def statute_provisions(docs: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """(keep, ord, path, unit, heading, text) of articles, paragraphs, items and supplements, in the order of the body.

    Preambles are left out. Items of a paragraph without a number hang on the article. Supplements are
    named by their date, or by their place without one; later ones of one date get ``~2`` and so on. XML
    that can't be read, or a null, gives no rows.
    """

    def article(x: Column) -> Column:
        path = F.concat(F.lit("a"), F.regexp_replace(x["조문번호"], "^0+(?=[0-9])", ""), _branch(x["조문가지번호"]))
        own = _row(path, "article", _plain(x["조문내용"], HEAD), F.nullif(F.btrim(x["조문제목"]), F.lit("")))
        return F.concat(F.array(own), _paragraphs(path, x["항"]))

    articles = F.filter(F.coalesce(F.col("_x.조문.조문단위"), F.array().cast(f"array<{ARTICLE}>")), lambda x: F.coalesce(x["조문여부"] != PREAMBLE, F.lit(True)))
    supplements = F.coalesce(F.col("_x.부칙.부칙단위"), F.array().cast(f"array<{SUPPLEMENT}>"))
    names = F.transform(supplements, lambda x, k: F.coalesce(F.concat(F.lit("supp@"), F.date_format(F.try_to_date(x["부칙공포일자"], "yyyyMMdd"), "yyyy-MM-dd")), F.concat(F.lit("supp#"), (k + 1).cast("string"))))

    def supplement(x: Column, k: Column) -> Column:
        nth = F.size(F.filter(F.slice("_names", 1, k + 1), lambda n: n == F.get("_names", k)))
        return _row(F.concat(F.get("_names", k), F.when(nth > 1, F.concat(F.lit("~"), nth.cast("string"))).otherwise("")), "supplement", _plain(x["부칙내용"]))

    d = docs.select(*keep, F.from_xml(F.col(xml), BODY).alias("_x")).withColumn("_names", names)
    rows = F.concat(F.flatten(F.transform(articles, article)), F.transform(supplements, supplement))
    return d.select(*keep, F.posexplode(rows).alias("ord", "_r")).select(*keep, "ord", "_r.*")


#: An administrative rule: articles as whole strings, supplements as brothers (fixed values).
ADMIN_RULE = "struct<`조문내용`:array<string>,`부칙`:struct<`부칙공포일자`:array<string>,`부칙내용`:array<string>>>"
ADMIN_ARTICLE = "^제\\s*([0-9]+)\\s*조(?:\\s*의\\s*([0-9]+))?\\s*(?:\\(([^()]*)\\))?\\s*"
ADMIN_PART = "^제\\s*([0-9]+)\\s*(장|절)\\s*([^\\n]*)"


def admin_rule_provisions(docs: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """(keep, ord, path, unit, heading, text) of an administrative rule's chapters, sections, articles, paragraphs and supplements.

    An article is one string; paragraphs begin at a round number that opens a line. A text without an
    article's number is ``bodyN``, N its place; a section without a chapter before it is left out. Dates of
    supplements count only if each has one. XML that can't be read, or a null, gives no rows.
    """
    none = F.lit(None).cast("string")
    blank = lambda c: F.nullif(F.btrim(c), F.lit(""))

    def chapter_at(k: Column) -> Column:
        before = F.filter(F.slice("_a", 1, k + 1), lambda y: F.regexp_extract(y, ADMIN_PART, 2) == "장")
        return F.when(F.size(before) > 0, F.concat(F.lit("c"), F.regexp_extract(F.element_at(before, -1), ADMIN_PART, 1)))

    def part(x: Column, k: Column) -> Column:
        chapter = chapter_at(k)
        section = F.concat(chapter, F.lit("-s"), F.regexp_extract(x, ADMIN_PART, 1))
        is_chapter = F.regexp_extract(x, ADMIN_PART, 2) == "장"
        row = F.struct(F.when(is_chapter, chapter).otherwise(section).alias("path"), F.when(is_chapter, "chapter").otherwise("section").alias("unit"), blank(F.regexp_extract(x, ADMIN_PART, 3)).alias("heading"), F.lit("").alias("text"))
        return F.when(chapter.isNotNull(), F.array(row)).otherwise(F.array().cast(ROW))

    def article(x: Column) -> Column:
        path = F.concat(F.lit("a"), F.regexp_extract(x, ADMIN_ARTICLE, 1), _branch(F.regexp_extract(x, ADMIN_ARTICLE, 2)))
        pieces = F.split(F.regexp_replace(x, ADMIN_ARTICLE, ""), f"(?:^|\\n)\\s*(?=[{ROUND_NUMBERS}])")
        signed = lambda y: F.position(F.substring(y, 1, 1), F.lit(ROUND_NUMBERS)) > 0
        own = F.coalesce(F.get(F.filter(pieces, lambda y: (y != "") & ~signed(y)), F.lit(0)), F.lit(""))
        paragraph = lambda y: _row(F.concat(path, F.lit(".p"), F.position(F.substring(y, 1, 1), F.lit(ROUND_NUMBERS)).cast("string")), "paragraph", _plain(y, f"^[{ROUND_NUMBERS}]"))
        return F.concat(F.array(_row(path, "article", _plain(own), blank(F.regexp_extract(x, ADMIN_ARTICLE, 3)))), F.transform(F.filter(pieces, lambda y: (y != "") & signed(y)), paragraph))

    def rows_of(x: Column, k: Column) -> Column:
        body = F.array(_row(F.concat(F.lit("body"), (k + 1).cast("string")), "article", _plain(x), none))
        return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast(ROW)).when(x.rlike(ADMIN_ARTICLE), article(x)).when(x.rlike(ADMIN_PART), part(x, k)).otherwise(body)

    d = docs.select(*keep, F.from_xml(F.col(xml), ADMIN_RULE).alias("_x"))
    texts = F.coalesce(F.col("_x.조문내용"), F.array().cast("array<string>"))
    d = d.withColumn("_a", F.transform(texts, lambda x: F.btrim(x, F.lit(" \n\t"))))
    said, dates = F.coalesce(F.col("_x.부칙.부칙내용"), F.array().cast("array<string>")), F.col("_x.부칙.부칙공포일자")
    day = lambda k: F.date_format(F.try_to_date(F.when(F.size(dates) == F.size(said), F.get(dates, k)), "yyyyMMdd"), "yyyy-MM-dd")
    names = F.transform(said, lambda x, k: F.coalesce(F.concat(F.lit("supp@"), day(k)), F.concat(F.lit("supp#"), (k + 1).cast("string"))))
    d = d.withColumns({"_said": said, "_names": names})

    def supplement(x: Column, k: Column) -> Column:
        nth = F.size(F.filter(F.slice("_names", 1, k + 1), lambda n: n == F.get("_names", k)))
        return _row(F.concat(F.get("_names", k), F.when(nth > 1, F.concat(F.lit("~"), nth.cast("string"))).otherwise("")), "supplement", _plain(x))

    rows = F.concat(F.flatten(F.transform("_a", rows_of)), F.transform("_said", supplement))
    return d.select(*keep, F.posexplode(rows).alias("ord", "_r")).select(*keep, "ord", "_r.*")


class _Paragraphs:
    """Parser target: text of the paragraphs of a section; one inside another comes first and isn't part of it."""

    def __init__(self) -> None:
        self.open: list[tuple[list[str], int]] = []
        self.inside, self.done = 0, []

    def start(self, tag: str, attributes: dict) -> None:
        name = tag.rpartition("}")[2]
        if name == "p":
            self.open.append(([], self.inside))
            self.inside = 0
        self.inside += name == "t"

    def data(self, text: str) -> None:
        if self.inside and self.open:
            self.open[-1][0].append(text)

    def end(self, tag: str) -> None:
        name = tag.rpartition("}")[2]
        self.inside -= name == "t"
        if name == "p":
            parts, self.inside = self.open.pop()
            self.done.append(" ".join("".join(parts).split()))

    def close(self) -> list[str]:
        return [x for x in self.done if x]


def _lines(content: bytes | None) -> list[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            found = [(int(m[1]), m[0]) for m in map(re.compile(r"Contents/section([0-9]+)\.xml$").match, z.namelist()) if m]
            return [x for _, name in sorted(found) for x in ElementTree.fromstring(z.read(name), parser=ElementTree.XMLParser(target=_Paragraphs()))]
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []


def zipped_lines(files: DataFrame) -> DataFrame:
    """(path, no, text) of the paragraphs of zipped files (path, content), sections in numeric order; files that can't be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = _lines(content)
                columns = [pa.array([path] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "no", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, no int, text string")
