"""Queries that structure texts further: inferred and leading sections, blocks and their offsets, projects, expanded lists,
the context of spans, page text, partial dates and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeshift.plans import projections as P
from lodeshift.plans import text as T
from lodeshift.plans.registry import SQL, query
from lodeshift.session import latest

_SPLIT, _SPLIT_ALL = "[,;·•]", "[,;·•&/]"


def _sql_items(x: str, marks: str) -> str:
    """SQL: the trimmed, non-empty items of a line without its bullet and label."""
    bare = f"(case when starts_with({x},'•') then trim(substr({x},2)) else {x} end)"
    body = f"(case when contains({bare},':') then substr({bare}, strpos({bare},':')+1) else {bare} end)"
    return f"list_filter(list_transform(string_split_regex({body},'{marks}'), lambda i: trim(i)), lambda i: i<>'')"


def _sql_listed(x: str) -> str:
    short = r"list_filter({0}, lambda i: len(string_split_regex(i,'\s+'))<=3 and regexp_matches(i,'[A-Za-z0-9]'))"
    few, every = _sql_items(x, _SPLIT), _sql_items(x, _SPLIT_ALL)
    return f"((len({few})>=2 and 2*len({short.format(few)})>=len({few})) or (len({every})>=3 and 2*len({short.format(every)})>=len({every})))"


def list_items(line, marks: str):
    """The trimmed, non-empty items of a line without its bullet and label."""
    bare = F.when(F.startswith(line, F.lit("•")), F.trim(F.substring(line, F.lit(2), F.length(line)))).otherwise(line)
    body = F.when(F.contains(bare, F.lit(":")), F.substring(bare, F.instr(bare, ":") + 1, F.length(bare))).otherwise(bare)
    return F.filter(F.transform(F.split(body, marks, -1), lambda i: F.trim(i)), lambda i: i != "")


def listed(line):
    """Whether a line lists short items: two or more between commas and bullets, or three or more with ampersands and slashes."""
    short = lambda items: F.size(F.filter(items, lambda i: (F.size(F.split(i, r"\s+", -1)) <= 3) & i.rlike("[A-Za-z0-9]")))
    few, every = list_items(line, _SPLIT), list_items(line, _SPLIT_ALL)
    return ((F.size(few) >= 2) & (2 * short(few) >= F.size(few))) | ((F.size(every) >= 3) & (2 * short(every) >= F.size(every)))


def lines_of(text):
    return F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n", -1), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))


_ARRAYS = r"""d as (select doc_id, list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x, ' '||chr(9))) l from documents where text is not null)"""
_HEADED = "(" + T._HEAD.replace("(t)", "(x)").replace("(t,", "(x,") + ") and x<>''"
_BULLETED = r"(?m)^[ \t]*[-*•]"
_PARAS = "list_filter(string_split(array_to_string({0}, chr(10)), chr(10)||chr(10)), lambda p: regexp_matches(p,'\\S'))"
_DEGREE = r"(?i)\b(?:BS|BA|MS|MBA|PhD|B\.S\.|M\.S\.|degree|university|college)\b"
_YEAR = r"\b(?:19|20)[0-9]{2}\b"


def _paragraphs(lines):
    return F.filter(F.split(F.array_join(lines, "\n"), "\n\n", -1), lambda p: p.rlike(r"\S"))


def _any_listed(paragraph):
    return F.exists(F.split(paragraph, "\n", -1), lambda x: listed(x))


_SQL_ANY = f"len(list_filter(string_split(p, chr(10)), lambda x: {_sql_listed('x')}))>0"


@query(rf"""with {_ARRAYS}, h as (select doc_id, {_PARAS.format('l')} a from d where len(list_filter(l, lambda x: {_HEADED}))=0), e as (select doc_id, len(a) n, unnest(range(1,len(a)+1)) i, unnest(a) p from h)
select doc_id, i::int pos, length(p) chars, case when i=1 then 'contact' when i=n then (case when regexp_matches(p,'{_YEAR}') and regexp_matches(p,'{_DEGREE}') then 'education' when {_SQL_ANY} then 'skills' else 'other' end)
 when {_SQL_ANY} then 'skills' when regexp_matches(p,'{_BULLETED}') then 'experience' when i=2 and n>3 then 'summary' else 'experience' end kind from e""")
def sec_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Sections of texts without any heading, by place and look of their paragraphs; all within the row."""
    lines = P.table(spark, d, "documents").where("text is not null").select("doc_id", lines_of(F.col("text")).alias("l"))
    bare = lines.where(~F.exists("l", lambda x: T.is_heading(x)))
    p = bare.select("doc_id", _paragraphs(F.col("l")).alias("a")).select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("i", "p")).withColumn("i", F.col("i") + 1).withColumn("listed", _any_listed(F.col("p")))
    last = F.when(F.col("p").rlike(_YEAR) & F.col("p").rlike(_DEGREE), "education").when(F.col("listed"), "skills").otherwise("other")
    middle = F.when(F.col("listed"), "skills").when(F.col("p").rlike(_BULLETED), "experience").when((F.col("i") == 2) & (F.col("n") > 3), "summary").otherwise("experience")
    return p.select("doc_id", F.col("i").alias("pos"), F.length("p").alias("chars"), F.when(F.col("i") == 1, "contact").when(F.col("i") == F.col("n"), last).otherwise(middle).alias("kind"))


@query(rf"""with {_ARRAYS}, f as (select doc_id, l, list_position(list_transform(l, lambda x: {_HEADED}), true) k from d), h as (select doc_id, {_PARAS.format('l[1:k-1]')} a from f where k>1), e as (select doc_id, unnest(range(1,len(a)+1)) i, unnest(a) p from h)
select doc_id, i::int pos, length(p) chars, case when i=1 then 'contact' when {_SQL_ANY} then 'skills' when regexp_matches(p,'{_BULLETED}') or contains(p,'|') then 'experience' else 'summary' end kind from e""")
def sec_leading(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the first heading, by paragraphs."""
    lines = P.table(spark, d, "documents").where("text is not null").select("doc_id", lines_of(F.col("text")).alias("l"))
    first = lines.withColumn("k", F.array_position(F.transform("l", lambda x: T.is_heading(x)), True)).where("k > 1")
    p = first.select("doc_id", _paragraphs(F.slice("l", F.lit(1), F.greatest(F.col("k").cast("int") - 1, F.lit(0)))).alias("a")).select("doc_id", F.posexplode("a").alias("i", "p"))
    kind = F.when(F.col("i") == 0, "contact").when(_any_listed(F.col("p")), "skills").when(F.col("p").rlike(_BULLETED) | F.contains("p", F.lit("|")), "experience").otherwise("summary")
    return p.select("doc_id", (F.col("i") + 1).alias("pos"), F.length("p").alias("chars"), kind.alias("kind"))


_B = """b as (select block_id, arg_max(candidate_id,(coalesce(loaded_at, timestamptz '0001-01-01'),candidate_id)) candidate_id, any_value(page) page, any_value(line_no) line_no, arg_max(text,(coalesce(loaded_at, timestamptz '0001-01-01'),text)) as text from line_blocks where candidate_id is not null and page is not null and text is not null and text<>'' group by block_id)"""


def page_blocks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Each block once, those with an owner, a page and a text."""
    blocks = P.table(spark, d, "line_blocks").where("candidate_id is not null and page is not null and text is not null and text <> ''")
    return latest(blocks, "block_id", "candidate_id", "page", "line_no", "text", *more)


@query(f"""with {_B} select block_id, candidate_id, (sum(length(text)+1) over (partition by candidate_id order by page, line_no nulls first, block_id) - length(text) - 1)::bigint as start, length(text) n from b""")
def int_block_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each block begins in the joined text of its owner. Pages are added up first and their sums run through, so an
    owner of very many lines is many small windows."""
    b = page_blocks(spark, d).withColumn("size", F.length("text") + 1)
    pages = b.groupBy("candidate_id", "page").agg(F.sum("size").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("candidate_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("size").over(Window.partitionBy("candidate_id", "page").orderBy("line_no", "block_id")) - F.col("size")
    joined = b.withColumn("within", within).join(pages.select("candidate_id", "page", before.alias("before")), ["candidate_id", "page"])
    return joined.select("block_id", "candidate_id", (F.col("before") + F.col("within")).alias("start"), F.length("text").alias("n"))


def blocks_in_span(span, blocks):
    """Of the texts ``blocks`` in order, the places (from 0) in ``span`` of those found one behind the other; the search goes
    on behind each found one, and one that isn't found is passed over."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc, block):
        place = F.position(block, span, acc["at"])
        return F.when((place > 0) & (block != ""), F.struct((place + F.length(block)).alias("at"), F.concat(acc["found"], F.array(place - 1)).alias("found"))).otherwise(acc)

    return F.aggregate(blocks, begin, step, lambda acc: acc["found"])


@query()
def sec_block_spans(spark: SparkSession, d: str) -> DataFrame:
    """Which lines of a page are found in order in its text, and where; the test compares with a plain search."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("line_no", F.lit(-(2**31))).alias("line_no"), "block_id", "text")))
    pages = page_blocks(spark, d).groupBy("candidate_id", "page").agg(ordered.alias("lines"))
    texts = F.transform("lines", lambda x: x["text"])
    return pages.select("candidate_id", "page", blocks_in_span(F.array_join(texts, "\n"), F.filter(texts, lambda x: F.length(x) > 3)).alias("places"))


PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
_BOX = "round(min(x0)/612e0,6) x0, round(min(top)/792e0,6) as top, round(max(x1)/612e0,6) x1, round(max(bottom)/792e0,6) bottom"


@query(f"""with b as (select block_id, any_value(candidate_id) candidate_id, any_value(page) page, any_value(line_no) line_no, arg_max(text,(coalesce(loaded_at, timestamptz '0001-01-01'),text)) as text, any_value(x0) x0, any_value(top) top, any_value(x1) x1, any_value(bottom) bottom from line_blocks where candidate_id is not null and page is not null and text is not null and text<>'' group by block_id),
k as (select * from b where not (coalesce(top, 0e0) > 0.92e0*792e0 and regexp_matches(text,'^\\s*[0-9]+\\s*$')))
select candidate_id, page, count(*) blocks, sha256(string_agg(text, chr(10) order by line_no nulls first, block_id)) as digest, sum(length(text))+count(*)-1 chars, {_BOX} from k group by 1,2""")
def ext_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each page, its lines joined in order without page numbers at the foot, and its box in the unit square."""
    b = page_blocks(spark, d, "x0", "top", "x1", "bottom")
    kept = b.where(~((F.coalesce("top", F.lit(0.0)) > 0.92 * PAGE_HEIGHT) & F.col("text").rlike(r"^\s*[0-9]+\s*$")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("line_no", F.lit(-(2**31))).alias("line_no"), "block_id", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    unit = lambda f, c, size: F.round(f(c) / size, 6).alias(c)
    by = kept.groupBy("candidate_id", "page").agg(F.count("*").alias("blocks"), joined.alias("text"), unit(F.min, "x0", PAGE_WIDTH), unit(F.min, "top", PAGE_HEIGHT), unit(F.max, "x1", PAGE_WIDTH), unit(F.max, "bottom", PAGE_HEIGHT))
    return by.select("candidate_id", "page", "blocks", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"), "x0", "top", "x1", "bottom")


@query(f"select doc_id, language, confidence, case when language not in ('en') then 'UNSUPPORTED_LANGUAGE' end code from ({SQL['ext_language_detect']})")
def ext_language_flag(spark: SparkSession, d: str) -> DataFrame:
    """The language of each text and the note that extraction gives where it isn't one it reads in full."""
    return T.ext_language_detect(spark, d).withColumn("code", F.when(~F.col("language").isin("en"), "UNSUPPORTED_LANGUAGE"))


# Typed ranges of years or months, as they stand in headers.
RANGE = T.DATES
_PROJECTS = [
    (-1, "Projects\nRoute planner 2019 – 2021\n- Wrote the solver\n- Mapped depots\n\nSeed bank\n* Catalogue of seeds, 2015-2016\n\n \nSkills\nSQL"),
    (-2, "Personal projects:\nChess engine\nwithout any date\n\nWeather station (2020 - present)\n• Soldered sensors"),
]
_PL = "p as (select doc_id, text from documents where text is not null union all values " + ", ".join("({}::bigint, '{}')".format(i, t.replace("'", "''")) for i, t in _PROJECTS) + "), l as (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) a from p), x as (select doc_id, unnest(range(1,len(a)+1)) i, unnest(a) raw from l), t as (select doc_id, i::int line, trim(raw, ' '||chr(9)) t from x)"


@query(rf"""with {_PL}, h as (select *, case when t<>'' and ({T._HEAD}) and not regexp_matches(t,'[12][0-9]{{3}}') then case {T._KIND} else 'other' end end k from t), f as (select *, last_value(k ignore nulls) over (partition by doc_id order by line) section, sum((t='')::int) over (partition by doc_id order by line) block from h)
select doc_id, block::int block, arg_min(t, line) title, count(*) filter (regexp_matches(t,'^[-*•]')) bullets, arg_min(nullif(regexp_extract(t,'{RANGE}'),''), line) filter (regexp_matches(t,'{RANGE}')) dates from f where section='projects' and k is null and t<>'' group by 1,2""")
def str_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects of a text's project sections: blocks between blank lines, with title, bullets and the first range of dates."""
    texts = P.table(spark, d, "documents").where("text is not null").select("doc_id", "text").unionByName(spark.createDataFrame(_PROJECTS, "doc_id long, text string"))
    lines = texts.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("i", "t")).withColumn("line", F.col("i") + 1)
    h = lines.withColumn("k", F.when(T.is_heading(F.col("t")) & ~F.col("t").rlike("[12][0-9]{3}"), T.section_kind(F.col("t"))))
    w = Window.partitionBy("doc_id").orderBy("line")
    f = h.withColumn("section", F.last("k", ignorenulls=True).over(w)).withColumn("block", F.sum((F.col("t") == "").cast("int")).over(w).cast("int"))
    dated = F.col("t").rlike(RANGE)
    kept = f.where("section = 'projects' and k is null and t <> ''")
    return kept.groupBy("doc_id", "block").agg(F.min_by("t", "line").alias("title"), F.sum(F.col("t").rlike(r"^[-*•]").cast("int")).cast("long").alias("bullets"), F.min_by(F.when(dated, F.regexp_extract("t", RANGE, 0)), F.when(dated, F.col("line"))).alias("dates"))


# Words that a list of skills isn't made of.
LIST_STOP = "a an and are as at be by for from has have in is it of on or that the to was were with via using such like including etc".split()
_STOP = ",".join(f"'{w}'" for w in LIST_STOP)


@query(rf"""with l as (select distinct block_id, text from line_blocks where text is not null and contains(text,',')), a as (select block_id, case when contains(text,':') then substr(text, strpos(text,':')+1) else text end t from l), s as (select block_id, string_split_regex(t,'[,;·•&/]|\s+and\s+') a from a),
e as (select block_id, unnest(range(1,len(a)+1)) i, unnest(a) x from s), c as (select block_id, i::int pos, rtrim(regexp_replace(trim(x),'\s+',' ','g'),'.') item from e)
select block_id, pos, item from c where regexp_matches(regexp_replace(lower(item),'[^a-z0-9+#]','','g'),'[a-z+#]') and (length(regexp_replace(lower(item),'[^a-z0-9+#]','','g'))>=2 or regexp_replace(lower(item),'[^a-z0-9+#]','','g') in ('c','r')) and regexp_replace(lower(item),'[^a-z0-9+#]','','g') not in ({_STOP})""")
def str_list_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The items of comma lists, without label, numbers, single letters and stop words."""
    l = P.table(spark, d, "line_blocks").where(F.contains("text", F.lit(","))).select("block_id", "text").distinct()
    body = F.when(F.contains("text", F.lit(":")), F.substring("text", F.instr("text", ":") + 1, F.length("text"))).otherwise(F.col("text"))
    e = l.select("block_id", F.posexplode(F.split(body, r"[,;·•&/]|\s+and\s+", -1)).alias("i", "x"))
    item = F.regexp_replace(F.regexp_replace(F.trim("x"), r"\s+", " "), r"\.+$", "")
    core = F.regexp_replace(F.lower("item"), "[^a-z0-9+#]", "")
    kept = core.rlike("[a-z+#]") & ((F.length(core) >= 2) | core.isin("c", "r")) & ~core.isin(*LIST_STOP)
    return e.select("block_id", (F.col("i") + 1).alias("pos"), item.alias("item")).where(kept)


_NEEDLE = r"(?i)\b(?:team|work|market|project|report|data|time|travail|arbeit|trabajo|plan)\b"


@query(rf"""with {T._LINES}, s as (select doc_id, text, length(regexp_extract(text,'^(?s:(.*?)){_NEEDLE}',1)) a, regexp_extract(text,'{_NEEDLE}') w from documents where text is not null and regexp_matches(text,'{_NEEDLE}')), h as (select *, case when t<>'' and ({T._HEAD}) then case {T._KIND} else 'other' end end k from t), f as (select doc_id, line, last_value(k ignore nulls) over (partition by doc_id order by line) section from h),
c as (select doc_id, a as start, a+length(w) as "end", trim(regexp_extract(substr(text,1,a),'[^.!?\n]*$')||w||regexp_extract(substr(text,a+length(w)+1),'^[^.!?\n]*')) sentence, length(replace(substr(text,1,a), chr(13), ''))-length(replace(replace(substr(text,1,a), chr(13), ''),chr(10),''))+1 line from s)
select doc_id, start, "end", sentence, coalesce(section,'leading') section from c left join f using(doc_id, line)""")
def str_span_context(spark: SparkSession, d: str) -> DataFrame:
    """For the first mention of some common words: its span, the sentence around it and the section it stands in. The
    section comes by an equal join on the line, no interval join."""
    t = P.table(spark, d, "documents").where("text is not null").where(F.col("text").rlike(_NEEDLE)).select("doc_id", "text", F.length(F.regexp_extract("text", rf"^(?s:(.*?)){_NEEDLE}", 1)).alias("start"), F.regexp_extract("text", _NEEDLE, 0).alias("w"))
    end = F.col("start") + F.length("w")
    before, behind = F.substring(F.col("text"), F.lit(1), F.col("start")), F.substring(F.col("text"), end + 1, F.length("text"))
    sentence = F.trim(F.concat(F.regexp_extract(before, r"([^.!?\n]*)\z", 1), "w", F.regexp_extract(behind, r"^([^.!?\n]*)", 1)))
    spans = t.select("doc_id", "start", end.alias("end"), sentence.alias("sentence"), (F.regexp_count(before, F.lit("\n")) + 1).alias("line"))
    h = T.document_lines(spark, d).withColumn("k", F.when(T.is_heading(F.col("t")), T.section_kind(F.col("t"))))
    f = h.select("doc_id", "line", F.last("k", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line")).alias("section"))
    return spans.join(f, ["doc_id", "line"], "left").select("doc_id", "start", "end", "sentence", F.coalesce("section", F.lit("leading")).alias("section"))


def partial_date(text):
    """A date written yyyy-mm-dd, yyyymmdd, yyyy-mm or yyyy, the first day where one is left out; NULL for the rest."""
    month = F.concat(F.substring(text, 1, 5), F.lpad(F.substring(text, 6, 2), 2, "0"), F.lit("-01"))
    whole = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text).when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).when(text.rlike("^[0-9]{4}-[0-9]{1,2}$"), month).when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-01-01")))
    return F.when(~F.startswith(text, F.lit("0000")), whole.try_cast("date"))


@query(r"""with s as (select start_date t from experience union all select end_date from experience union all select graduation_date from education union all values ('20200229'),('2021-02-29'),('2020-3'),('0000'),('2020-13')), d as (select distinct t from s where t is not null)
select t as typed, case when not starts_with(t,'0000') then try_cast(case when regexp_matches(t,'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then t when regexp_matches(t,'^[0-9]{8}$') then substr(t,1,4)||'-'||substr(t,5,2)||'-'||substr(t,7,2) when regexp_matches(t,'^[0-9]{4}-[0-9]{1,2}$') then substr(t,1,5)||lpad(substr(t,6,2),2,'0')||'-01' when regexp_matches(t,'^[0-9]{4}$') then t||'-01-01' end as date) end::varchar as date from d""")
def dat_partial_iso(spark: SparkSession, d: str) -> DataFrame:
    x, e = P.table(spark, d, "experience"), P.table(spark, d, "education")
    typed = x.select(F.col("start_date").alias("t")).unionByName(x.select(F.col("end_date").alias("t"))).unionByName(e.select(F.col("graduation_date").alias("t")))
    typed = typed.unionByName(spark.createDataFrame([("20200229",), ("2021-02-29",), ("2020-3",), ("0000",), ("2020-13",)], "t string")).where("t is not null").distinct()
    return typed.select(F.col("t").alias("typed"), partial_date(F.col("t")).cast("string").alias("date"))


def match_spans(text, pattern: str):
    """The (start, end) of all matches of ``pattern``, in code points, put together from the pieces between them."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        a = acc["at"] + F.length(x["p"])
        b = a + F.length(x["h"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end")))).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: x["h"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda acc: acc["out"])


def without_spans(text, spans):
    """The text without the spans (sorted, apart from each other); those beyond its end are clamped."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        a, b = F.least(F.greatest(s["start"], acc["at"]), F.length(text)), F.least(F.greatest(s["end"], acc["at"]), F.length(text))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, a - acc["at"])).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


@query(f"""with {T._SEEDED}, p as (select doc_id, string_split_regex(text,'{T._INJ}') p, regexp_extract_all(text,'{T._INJ}') h from s where regexp_matches(text,'{T._INJ}')), e as (select doc_id, unnest(range(1,len(h)+1)) i, unnest(h) h, unnest(p[1:len(h)]) p from p)
select doc_id, (sum(length(p)+length(h)) over (partition by doc_id order by i) - length(h))::int as start, (sum(length(p)+length(h)) over (partition by doc_id order by i))::int as "end", h as quote from e""")
def int_injection_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every instruction meant for a model, with its place."""
    t = T.seeded(spark, d).where(F.col("text").rlike(T._INJ))
    s = t.select("doc_id", "text", F.explode(match_spans(F.col("text"), T._INJ)).alias("s"))
    return s.select("doc_id", "s.start", "s.end", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("quote"))


@query(f"with {T._SEEDED} select doc_id, regexp_replace(text,'{T._INJ}','','g') as text from s")
def txt_span_removal(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the spans in quarantine, by the spans themselves."""
    t = T.seeded(spark, d)
    return t.select("doc_id", without_spans(F.col("text"), match_spans(F.col("text"), T._INJ)).alias("text"))


@query(f"""select 'candidate' origin, candidate_id id, 'HIDDEN_TEXT' code from ({SQL['int_hidden_text']}) where flagged union all select 'document', doc_id::varchar, 'PROMPT_INJECTION' from ({SQL['int_injection']}) union all select distinct 'document', doc_id::varchar, 'KEYWORD_STUFFING' from ({SQL['int_repeats']})
union all select 'candidate', candidate_id, 'UNNARRATED_SKILLS' from ({SQL['int_unnarrated']}) where flagged union all select 'candidate', candidate_id, 'SKILL_SHARE' from ({SQL['int_skill_share']}) where flagged""")
def int_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all detectors, one row each."""
    of = lambda df, origin, key, code: df.select(F.lit(origin).alias("origin"), F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))
    parts = [
        of(T.int_hidden_text(spark, d).where("flagged"), "candidate", "candidate_id", "HIDDEN_TEXT"), of(T.int_injection(spark, d), "document", "doc_id", "PROMPT_INJECTION"),
        of(T.int_repeats(spark, d).select("doc_id").distinct(), "document", "doc_id", "KEYWORD_STUFFING"), of(T.int_unnarrated(spark, d).where("flagged"), "candidate", "candidate_id", "UNNARRATED_SKILLS"),
        of(T.int_skill_share(spark, d).where("flagged"), "candidate", "candidate_id", "SKILL_SHARE"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TERMS = ["speech therapy", "battery testing", "release management", "patent research", "signal analysis", "network cabling", "classroom teaching", "first aid", "water treatment", "arc welding", "grid protection", "solar installation", "payroll accounting", "test scripting"]
_TERMS = "(?i)" + chr(92) + "b(?:" + "|".join(TERMS) + ")" + chr(92) + "b"


@query(f"""with p as (select block_id, string_split_regex(text,'{_TERMS}') p, regexp_extract_all(text,'{_TERMS}') h from (select distinct block_id, text from line_blocks) where regexp_matches(coalesce(text,''),'{_TERMS}')), e as (select block_id, unnest(range(1,len(h)+1)) i, unnest(h) h, unnest(p[1:len(h)]) p from p)
select block_id, lower(h) as term, (sum(length(p)+length(h)) over (partition by block_id order by i) - length(h))::int as start, (sum(length(p)+length(h)) over (partition by block_id order by i))::int as "end" from e""")
def str_term_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of terms of several words in lines, with its place in code points."""
    t = P.table(spark, d, "line_blocks").where(F.coalesce("text", F.lit("")).rlike(_TERMS)).select("block_id", "text").distinct()
    s = t.select("block_id", "text", F.explode(match_spans(F.col("text"), _TERMS)).alias("s"))
    return s.select("block_id", F.lower(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("term"), "s.start", "s.end")
