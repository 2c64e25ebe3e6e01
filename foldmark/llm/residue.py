"""Documents with template residue, filler, error pages or script notices instead of content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.llm import exemplars as X
from foldmark.operators.layout import spread
from foldmark.operators.skew import split_join
from foldmark.session import Scratch

#: Least share of an exemplar that a window must contain, by TF-IDF weight.
CONTAINMENT = 0.8

#: HTTP status codes of error pages: fixed values.
STATUS_CODES = (400, 401, 402, 403, 404, 405, 406, 407, 408, 409, 410, 411, 412, 413, 414, 415, 417, 418, 421, 422, 423, 425, 426, 428, 429, 431, 451, 500, 501, 502, 503, 504, 505, 507, 508, 511, 520, 521, 522, 523, 524, 525, 526)
#: Terms of an HTTP status, of a word said three times or more or keys hit at random, and of capitals alone between delimiters.
STATUS, REPEAT, CAPS = "‹status›", "‹repeat›", "‹caps›"
#: Names with two underscores on both sides that a language defines, and HTML elements: fixed values.
_DUNDERS = "init|main|name|file|all|doc|str|repr|len|new|del|call|dict|class|enter|exit|iter|next|eq|hash|version|author|future|slots|pycache|tests|mocks"
_ELEMENTS = "HTML|HEAD|TITLE|BODY|H[1-6]|P|DIV|SPAN|NOSCRIPT|BR|HR|A|B|I|UL|OL|LI|PRE|CODE|TABLE|TR|TD|TH|META|LINK|SCRIPT|STYLE|IMG|EM|STRONG|FORM|INPUT|CENTER|FONT"
#: Notations that have no use in prose but to be filled: fixed values.
_HARD = (
    r"\{\{[^{}]++\}\}", r"\{%(?:[^{}%]|%(?!\}))++%\}", r"<%(?:[^<>%]|%(?!>))++%>", r"\$\{[^{}]++\}", r"\$\([A-Z_][A-Z0-9_]*+\)", r"#\{[^{}]++\}", r"%\([A-Za-z_]\w*+\)[sdfr]", r"%%[A-Za-z_]\w*+%%", r"@@[A-Za-z_]\w*+@@", r"(?<![\w$])\$[A-Z][A-Z0-9_]++\$(?![\w$])",
    r"::[A-Za-z_]\w*+::", r"\[\[[^\[\]]++\]\]", r"<<[A-Za-z_ ]++>>", r"\*\|[A-Z_:]++\|\*", r"\bXXXX-[A-Za-z_ ]++-XXXX\b", r"\bxxxx-[a-z_ ]++-xxxx\b", rf"\b__(?!(?:{_DUNDERS})__)[A-Za-z][A-Za-z0-9]*+(?:_[A-Za-z0-9]++)*+__(?!\w)", r"\{[A-Za-z0-9_][\w.-]*+\}",
)
#: Notations that also have other uses, so that their words decide: fixed values.
_SOFT = (
    r"\[[^\[\]]++\](?![(\[]|:\s*+(?:[/#<.]|\w++://))", rf"<(?!(?:{_ELEMENTS})>)[A-Za-z][^<>/=\"]*+>", r"<!-- ?[A-Za-z][\w .-]*?-->", r"«[A-Za-z_][^«»]*+»", r"\{[A-Za-z][\w.-]*+(?: [\w.-]++)++\}", r"(?<![\w%])%[A-Z][A-Z0-9_]++%(?![\w%])", r"\b(?:TODO|todo|Todo): ?[A-Za-z]++(?: [\w-]++){0,2}+",
)
_SPANS = rf"(?=[{{<$#%@:\[«XxTt_*])(?:{'|'.join(_HARD + _SOFT)})"
#: What each of the notations holds.
_MARKS = ("{", "[", "«", "<", "$", "%", "@@", "::", "__", "*|", "XXXX", "xxxx", "TODO:", "todo:", "Todo:")
_QUOTED = rf"[\"“”'](?:{_SPANS})[\"“”']"
#: Start of a line that a program logged, or of a list entry that explains a code.
_REPORTED = r"^(?:\s*[-*•] ?\d{1,3} ?[:=] |\W{0,3}(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:DEBUG|INFO|WARN|WARNING|TRACE)\b|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d |\d{1,3}(?:\.\d{1,3}){3} - ))"
#: Ends of sentences, but not inside brackets that close in the next one.
_SENTENCE = r"(?<=[.!?])[\s\x{a0}]+(?![^\[\]{}<>.!?]*[\]}>])"
_RUN = r"\b(\p{L}{3,}+(?: \p{L}++)??)(?:[\x{a0} ,]+\1\b){2,}+"
_NAMES = r"\b\p{L}*+(?:[\p{N}_/-]|\.(?=[\p{L}\p{N}]))(?:[\p{L}\p{N}_/-]|\.(?=[\p{L}\p{N}]))*+"
_COMPOUND = r"(?<![\p{L}\p{N}_/-])\p{L}++[-_]\p{L}++(?![\p{L}\p{N}_/-])"
_STATUS = rf"(?<![\w/.-])(?=[45]\d\d)(?:{'|'.join(map(str, STATUS_CODES))})(?![\w/-])"
#: Letters with accents as they look after UTF-8 was read as Latin-1.
_BROKEN = [(c, c.encode().decode("latin-1")) for c in map(chr, range(0xC0, 0x100))]
_MASHED = r"^(?:[asdfghjkl\x{a0} ;,.]{8,}+|[qwertyuiop\x{a0} ,.]{8,}+|[zxcvbnm\x{a0} ,.]{8,}+)$"


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def _guarded(text: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """Replace only where one of the literal marks occurs, which most texts fail at once."""
    return F.when(_holds(text, marks), F.regexp_replace(text, F.lit(pattern), F.lit(by))).otherwise(text)


def _none() -> Column:
    return F.array().cast("array<string>")


def _span_terms(span: Column) -> Column:
    """Terms of a placeholder: its opening delimiter as a shape and, where the notation has other uses, capitals and its words."""
    opening = F.regexp_extract(span, r"^(?:\{\{|\{%|<%|\$\{|\$\(|#\{|%\(|%%|@@|\[\[|<!--|::|<<|\*\||__|(?:XXXX|xxxx)-|[\[<«{$%])", 0)
    hard = ~opening.isin("", "[", "<", "«", "<!--", "%", "{") | ((opening == "{") & ~F.contains(span, F.lit(" ")))
    words = F.filter(F.split(F.lower(span), r"[^\p{L}]+"), lambda x: x != "")
    capitals = F.when(span.rlike(r"\p{Lu}{2}") & ~span.rlike(r"\p{Ll}"), F.array(F.lit(CAPS))).otherwise(_none())
    shape = F.when(opening == "", _none()).otherwise(F.array(F.concat(F.lit("‹"), F.lower(opening), F.lit("›"))))
    return F.array_distinct(F.concat(shape, F.when(hard, _none()).otherwise(F.concat(capitals, words))))


def windows(documents: DataFrame, doc_id: str, text: str, vocabulary: list[str] | None = None) -> DataFrame:
    """doc_id, w, part, terms: the different terms of each passage window of each document.

    A passage is a line or a sentence of one; ``w`` counts them. Part 0 is the
    passage itself, parts from 1 on are the placeholders in it, each a window of
    its own. Names, numbers, paths and digests are no terms. Code, fenced, between backticks or in code elements, and a
    placeholder set directly in quotation marks are taken out: a text that
    quotes residue is no case. Of a line that a program logged, or a list
    entry that explains a code, only the placeholders are windows. Letters with accents
    are mended where UTF-8 was read as Latin-1. Compounds count where the ``vocabulary`` knows
    them joined (without one, all do). Null and blank texts have no window;
    texts of any length are read whole.
    """
    # one step per column throughout, so that none is evaluated twice
    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))).where(F.length(F.trim("t")) > 0)
    rows = rows.select("doc_id", _guarded(F.col("t"), ("`",), r"(?s)```.*?(?:```|\z)|`[^`\n]*+`", " ").alias("t"))
    rows = rows.select("doc_id", _guarded(F.col("t"), ("<code", "<pre"), r"(?s)<(code|pre)\b.*?</\1>", " ").alias("t"))
    mended = reduce(lambda t, b: F.replace(t, F.lit(b[1]), F.lit(b[0])), _BROKEN, F.col("t"))
    rows = rows.select("doc_id", F.when(F.contains("t", F.lit("Ã")), mended).otherwise(F.col("t")).alias("t"))
    rows = rows.select("doc_id", F.split("t", r"[\r\n\x{2028}\x{2029}]+").alias("lines"))
    cut = F.flatten(F.transform("lines", lambda x: F.when(x.rlike(_REPORTED), F.array(x)).otherwise(F.split(x, _SENTENCE))))
    rows = rows.select("doc_id", F.posexplode(cut).alias("w", "passage")).where(F.length("passage") > 1)
    passage = F.col("passage")
    marked = _holds(passage, _MARKS)
    spans = F.filter(F.regexp_extract_all("passage", F.lit(f"{_QUOTED}|{_SPANS}"), F.lit(0)), lambda x: ~F.substring(x, 1, 1).isin('"', "“", "”", "'"))
    spans = F.when(marked, spans).otherwise(_none())
    rows = rows.select("doc_id", "w", "passage", spans.alias("spans"))
    prose = F.when(F.size("spans") > 0, F.regexp_replace("passage", F.lit(_SPANS), F.lit(" "))).otherwise(passage)
    rows = rows.select("doc_id", "w", "spans", F.when(passage.rlike(_REPORTED), F.lit("")).otherwise(F.lower(prose)).alias("prose"))
    rows = rows.select("doc_id", "w", "spans", _guarded(F.col("prose"), ("<", "&"), r"</?[a-z][^<>]*+>|&[a-z]++;", " ").alias("prose"))
    prose = F.col("prose")
    plain = lambda text: F.array_remove(F.split(F.regexp_replace(text, F.lit(_NAMES), F.lit(" ")), r"[^\p{L}]+"), "")
    rows = rows.select("*", plain(prose).alias("plain"))
    rows = rows.select("*", F.array_distinct("plain").alias("terms"))
    mashed = prose.rlike(_MASHED)
    repeated = F.when(F.size("terms") <= F.size("plain") - 2, prose.rlike(_RUN)).otherwise(F.lit(False))
    words = F.when(mashed, F.array(F.lit(REPEAT))).when(repeated, F.concat(F.array(F.lit(REPEAT)), F.array_distinct(plain(F.regexp_replace(prose, F.lit(_RUN), F.lit(" ")))))).otherwise(F.col("terms"))
    known = lambda x: F.lit(True) if vocabulary is None else x.isin(vocabulary)
    compounds = F.filter(F.transform(F.regexp_extract_all("prose", F.lit(_COMPOUND), F.lit(0)), lambda x: F.translate(x, "-_", "")), known)
    compounds = F.when(F.contains(prose, F.lit("-")) | F.contains(prose, F.lit("_")), compounds).otherwise(_none())
    status = F.when(prose.rlike(_STATUS), F.array(F.lit(STATUS))).otherwise(_none())
    parts = F.concat(F.array(F.concat(words, F.array_except(compounds, "terms"), status)), F.transform("spans", _span_terms))
    return rows.select("doc_id", "w", F.posexplode(parts).alias("part", "terms")).where(F.size("terms") > 0)


def _catalogue(spark: SparkSession) -> tuple[list[tuple[str, frozenset[str]]], dict[str, set[str]]]:
    """The exemplars as (kind, terms), and the vocabulary of each kind. Both are bounded by the exemplar file."""
    rows = [(k, *e) for k, e in enumerate(X.exemplars())]
    texts = spark.createDataFrame([(k, text) for k, _, _, text in rows], "doc_id int, text string")
    terms: dict[int, set[str]] = {}
    for r in windows(texts.coalesce(1), "doc_id", "text").select("doc_id", "terms").collect():
        # the name that stands for any other is no term
        terms.setdefault(r["doc_id"], set()).update(set(r["terms"]) - {"any"})
    kinds: dict[str, set[str]] = {}
    for k, kind, _, _ in rows:
        kinds.setdefault(kind, set()).update(terms.get(k, ()))
    return list(dict.fromkeys((kind, frozenset(terms[k])) for k, kind, whole, _ in rows if whole and k in terms)), kinds


def matches(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Windows that match a kind of exemplars: doc_id, w, part, kind, containment, coverage.

    Term weights are idf over all windows of all documents. The inverted index
    holds the heaviest terms of each exemplar, such that a window without any
    of them cannot contain enough of it, so retrieval loses no match, however
    frequent the terms are. Retrieved windows are then scored on all terms:
    containment is the share of an exemplar's weight found in the window (the
    largest over the kind), coverage the share of the window's weight that the
    kind's vocabulary explains; the kind states the least coverage and number
    of terms. The catalogue is fixed, so the index is small whatever the corpus.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "residue")
    catalogue, kinds = _catalogue(spark)
    vocabulary = sorted({t for terms in kinds.values() for t in terms})
    parts = scratch.write(windows(documents, doc_id, text, vocabulary).withColumn("print", F.xxhash64("terms")), "windows")
    n = parts.count()
    counts = scratch.write(parts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "counts")
    idf = F.log((F.lit(n) + 1) / (F.col("df") + 0.5))
    # at most one row per term of the catalogue
    met = {r["term"]: r["weight"] for r in counts.where(F.col("term").isin(vocabulary)).select("term", idf.alias("weight")).collect()}
    rare = max([*met.values(), 1.0])
    index: dict[str, list[tuple]] = {}
    for kind, terms in catalogue:
        total = left = float(sum(met.get(t, rare) for t in terms))
        for t in sorted(terms, key=lambda t: (-met.get(t, rare), t)):
            index.setdefault(t, []).append((kind, total, sorted(terms)))
            left -= met.get(t, rare)
            if left < CONTAINMENT * total:
                break
    lookup = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    postings = {t: es for t, es in index.items() if t in met}
    # the index's dictionary is a few hundred words, so a window is looked up where it lies and moves only if retrieved
    retrieved = parts.where(F.exists("terms", lambda x: x.isin(sorted(postings))))
    # windows of the same terms are scored once
    prints = retrieved.groupBy("print").agg(F.first("terms").alias("terms"))
    scored = split_join(prints.select("print", F.explode("terms").alias("term")), counts, ["term"]).select("print", F.struct("term", idf.alias("weight")).alias("t"))
    # a print is one passage, so its terms are those of one row before
    whole = scratch.write(scored.groupBy("print").agg(F.collect_list("t").alias("ts")), "scored")
    by_term = lookup(list(postings.items()), "term string, es array<struct<kind:string,total:double,terms:array<string>>>")
    found = lambda e: F.aggregate("ts", F.lit(0.0), lambda a, t: a + F.when(F.array_contains(e["terms"], t["term"]), t["weight"]).otherwise(0.0)) / e["total"]
    hits = F.filter(F.transform("es", lambda e: F.struct(e["kind"].alias("kind"), found(e).alias("containment"))), lambda h: h["containment"] >= CONTAINMENT - 1e-9)
    met_terms = whole.select("print", "ts", F.explode(F.transform("ts", lambda t: t["term"])).alias("term")).join(by_term, "term")
    contained = met_terms.select("print", F.inline(hits)).groupBy("print", "kind").agg(F.max("containment").alias("containment"))
    rules = [(kind, rule.coverage, rule.least_terms, sorted(kinds[kind])) for kind, rule in X.KINDS.items()]
    judged = contained.join(lookup(rules, "kind string, least_coverage double, least_terms int, words array<string>"), "kind").join(whole, "print")
    sums = lambda ts: F.aggregate(ts, F.lit(0.0), lambda a, t: a + t["weight"])
    judged = judged.select("*", F.filter("ts", lambda t: F.array_contains("words", t["term"])).alias("covered"))
    judged = judged.select("print", "kind", "containment", (sums(F.col("covered")) / sums(F.col("ts"))).alias("coverage"), F.size("covered").alias("n_met"), "least_coverage", "least_terms")
    judged = scratch.write(judged.where((F.col("coverage") >= F.col("least_coverage") - 1e-9) & (F.col("n_met") >= F.col("least_terms"))).drop("n_met", "least_coverage", "least_terms"), "judged")
    # placeholders are judged by the exemplars of placeholders, passages by the others
    fits = F.col("kind").isin("slot", "blank") == (F.col("part") > 0)
    of_print = judged.groupBy("print").agg(F.collect_list(F.struct("kind", "containment", "coverage")).alias("kinds"))
    return split_join(retrieved.select("doc_id", "w", "part", "print"), of_print, ["print"]).select("doc_id", "w", "part", F.inline("kinds")).where(fits)


def residue_documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id of every document with a window of residue, once each.

    A placeholder in a notation with other uses is excused by a sentence that
    mentions such notations; one in a notation without other uses by nothing
    but code and quotation. Null and blank texts and an empty table give no
    row; rows that repeat a doc_id are judged together.
    """
    found = matches(documents, doc_id, text)
    residue = [k for k, rule in X.KINDS.items() if rule.residue and k != "blank"]
    verdict = found.groupBy("doc_id", "w").agg(F.max(F.col("kind").isin(residue)).alias("bad"), F.max(F.col("kind") == "blank").alias("blank"), F.max(F.col("kind") == "mention").alias("shown"))
    return verdict.where("bad or (blank and not shown)").select("doc_id").distinct()
