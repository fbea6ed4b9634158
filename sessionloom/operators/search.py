"""Full-text search over posting tables: phrases, AND, BM25 and snippets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("project_name", "git_branch", "ai_title", "summary", "user_messages", "asst_messages", "tools_used", "files_modified")
TOKEN = r"[\p{L}\p{N}\p{Co}\p{M}]+"
K1, B = 1.2, 0.75


def folded(term: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def _measure(stem: str) -> int:
    shape = re.sub(r"[^v]+", "c", re.sub(r"[v]+", "v", _shape(stem)))
    return shape.count("vc")


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


#: Suffixes of the stemmer's later steps. Fixed values of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _mapped(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stemmed(word: str) -> str:
    """Porter's stem of a lower-case ASCII word; other words stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif _double(stem) and stem[-1] not in "lsz":
                    word = stem[:-1]
                else:
                    word = stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(_mapped(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@dataclass(frozen=True)
class Analysis:
    fold: bool = True
    stem: bool = True

    def term(self, token: str) -> str:
        token = token.lower()
        token = folded(token) if self.fold else token
        return stemmed(token) if self.stem else token


def tokens_of(text: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, text.lower())


def fields_of(sessions: DataFrame) -> DataFrame:
    """session_uuid, field, text: the searchable fields, arrays joined by spaces, nulls as empty."""
    def text(c: str) -> Column:
        return F.coalesce(F.array_join(c, " ") if dict(sessions.dtypes)[c].startswith("array") else F.col(c), F.lit(""))

    have = [c for c in FIELDS if c in sessions.columns]
    return sessions.select("session_uuid", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("text")) for c in have])))


def _tokens(fields: DataFrame) -> DataFrame:
    return fields.select("session_uuid", "field", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0)).alias("pos", "token"))


def new_terms(fields: DataFrame, known: DataFrame | None = None, analysis: Analysis = Analysis()) -> DataFrame:
    """token, term of the tokens that a dictionary (token, term) doesn't hold yet. Only these go through Python, each once."""
    tokens = _tokens(fields).select("token").distinct()
    tokens = tokens.join(known.select("token"), "token", "left_anti") if known is not None else tokens
    return _with_term(tokens, analysis)


def _with_term(tokens: DataFrame, analysis: Analysis) -> DataFrame:
    if not (analysis.fold or analysis.stem):
        return tokens.withColumn("term", F.col("token"))

    @F.pandas_udf("string")
    def to_term(t: pd.Series) -> pd.Series:
        return t.map(analysis.term)

    return tokens.withColumn("term", to_term("token"))


def postings(fields: DataFrame, analysis: Analysis = Analysis(), dictionary: DataFrame | None = None) -> DataFrame:
    """term, session_uuid, field, tf, positions of each term in each field.

    A dictionary (token, term) must hold all tokens; without one it is made from the distinct tokens."""
    rows = _tokens(fields).groupBy("session_uuid", "field", "token").agg(F.collect_list("pos").alias("positions"))
    if dictionary is not None:
        rows = rows.join(dictionary.select("token", "term"), "token")
    elif analysis.fold or analysis.stem:
        rows = rows.join(_with_term(rows.select("token").distinct(), analysis), "token")
    else:
        rows = rows.withColumn("term", F.col("token"))
    rows = rows.groupBy("term", "session_uuid", "field").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows.select("term", "session_uuid", "field", F.size("positions").alias("tf"), "positions")


def term_counts(index: DataFrame, stats: DataFrame, sign: int = 1) -> DataFrame:
    """term, n, tokens: in how many sessions each term is; the row of the empty term has the number of sessions and of their
    tokens. Counts add up over sets of sessions, with sign -1 they take sessions away."""
    rows = index.select("term", "session_uuid").distinct().groupBy("term").agg((F.count("*") * sign).alias("n"), F.lit(0).cast("long").alias("tokens"))
    whole = stats.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("doc_len"), F.lit(0)) * sign).cast("long").alias("tokens"))
    return rows.unionByName(whole.select(F.lit("").alias("term"), "n", "tokens"))


def doc_stats(fields: DataFrame) -> DataFrame:
    return fields.groupBy("session_uuid").agg(F.sum(F.regexp_count("text", F.lit(TOKEN))).cast("long").alias("doc_len"))


POSTINGS, LENGTHS, BUCKETS = "term string, session_uuid string, field string, tf int, positions array<int>, bucket int", "session_uuid string, doc_len long", 64


def write_index(fields: DataFrame, path: str, analysis: Analysis = Analysis(), buckets: int = BUCKETS) -> None:
    """Stores the postings and lengths of fields below path, the postings in buckets of terms and sorted by term.

    A whole index is made anew; one that grows with its sessions is kept by the Store."""
    index = postings(fields, analysis).withColumn("bucket", F.expr(f"pmod(xxhash64(term), {buckets})").cast("int"))
    index.repartition("bucket", F.expr("pmod(xxhash64(term, 1), 8)")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    doc_stats(fields).write.mode("overwrite").parquet(f"{path}/doc_stats")


def _bucket(term: str, buckets: int) -> int:
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def read_index(spark, path: str, query: str | None = None, analysis: Analysis = Analysis(), buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of a stored index of so many buckets; for a query only the buckets of its terms are read."""
    index, stats = spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(LENGTHS).parquet(f"{path}/doc_stats")
    if query is not None:
        index = index.where(F.col("bucket").isin(*{_bucket(t, buckets) for p in phrases_of(query, analysis) for t in p}))
    return index.drop("bucket"), stats


def phrases_of(query: str, analysis: Analysis) -> list[list[str]]:
    """White-space parts of a query, each a phrase of one or more terms. Parts without letters or digits are left out."""
    return [p for p in ([analysis.term(t) for t in tokens_of(part)] for part in query.split()) if p]


def phrase_hits(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """phrase, session_uuid, f: how often each phrase occurs in a session, over all fields.

    One scan takes the postings of all terms, and one exchange brings a session's together. An index with a batch column
    keeps it, so that postings of replaced sessions can be told apart.
    """
    key = ["session_uuid"] + (["batch"] if "batch" in index.columns else [])
    terms = sorted({t for p in phrases for t in p})
    at = {t: f"at{i}" for i, t in enumerate(terms)}
    here = index.where(F.col("term").isin(*terms)).select(*key, "field", "term", "positions").repartition(*[F.col(k) for k in key])
    fields = here.groupBy(*key, "field").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(c) for t, c in at.items()])

    def starts(terms: list[str]) -> Column:
        found = F.col(at[terms[0]])
        for k, t in enumerate(terms[1:], 1):
            found = F.array_intersect(found, F.transform(at[t], lambda p: p - k))  # noqa: B023
        return F.coalesce(F.size(found), F.lit(0))

    # a session that lacks the first term of all phrases holds none of them
    counts = F.array(*[F.struct(F.lit(i).alias("phrase"), F.greatest(starts(p), F.lit(0)).alias("n")) for i, p in enumerate(phrases)])
    rows = fields.select(*key, F.inline(F.filter(counts, lambda c: c["n"] > 0)))
    return rows.groupBy(*key, "phrase").agg(F.sum("n").alias("f"))


def ranked(index: DataFrame, stats: DataFrame, query: str, analysis: Analysis = Analysis(), counts: DataFrame | None = None) -> DataFrame:
    """session_uuid, rank of the sessions that hold every phrase; lower is better. No phrase: no row.

    With counts (of term_counts, any number of rows for a term) the corpus's size and the sessions of phrases of one term are
    looked up, at most a row for each term of the query; else they are counted."""
    phrases = phrases_of(query, analysis)
    if not phrases:
        return stats.where("false").select("session_uuid", F.lit(0.0).alias("rank"))
    key = ["session_uuid"] + (["batch"] if {"batch"} <= set(index.columns) & set(stats.columns) else [])
    hits = phrase_hits(index, phrases).join(stats, key)
    known, fixed = {}, {}
    if counts is not None:
        terms = {t for p in phrases for t in p}
        known = {r.term: r for r in counts.where(F.col("term").isin("", *terms)).groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
        fixed = {i: known[p[0]].n if p[0] in known else 0 for i, p in enumerate(phrases) if len(p) == 1}
    if len(fixed) < len(phrases):
        found = hits.where(~F.col("phrase").isin(*fixed)) if fixed else hits
        scored = hits.join(F.broadcast(found.groupBy("phrase").agg(F.count("*").alias("n"))), "phrase", "left")
    else:
        scored = hits.withColumn("n", F.lit(None).cast("long"))
    if fixed:
        looked_up = F.create_map(*[F.lit(x) for i, n in fixed.items() for x in (i, n)])
        scored = scored.withColumn("n", F.coalesce(F.try_element_at(looked_up, "phrase"), "n"))
    if counts is not None:
        size, tokens = (known[""].n, known[""].tokens) if "" in known else (0, 0)
        scored = scored.withColumns({"corpus_size": F.lit(size), "avg_len": F.lit(tokens / size if size else None).cast("double")})
    else:
        scored = scored.crossJoin(F.broadcast(stats.agg(F.count("*").alias("corpus_size"), F.avg("doc_len").alias("avg_len"))))
    idf = F.log((F.col("corpus_size") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    f = F.col("f")
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    rows = scored.groupBy("session_uuid").agg((-F.sum(part)).alias("rank"), F.count("*").alias("n"))
    return rows.where(F.col("n") == len(phrases)).select("session_uuid", "rank")


def snippet(text: str | None, phrases: list[list[str]], analysis: Analysis, width: int = 15) -> str:
    """The best window of width tokens of a text, with the phrases marked."""
    import regex

    text = text or ""
    found = list(regex.finditer(TOKEN, text, regex.IGNORECASE))
    terms = [analysis.term(m[0]) for m in found]
    n = len(terms)
    if not n:
        return text
    hits = sorted((o, i) for i, p in enumerate(phrases) for o in range(n - len(p) + 1) if terms[o : o + len(p)] == p)
    starts = [k for k in range(n) if k == 0 or (text[found[k].start() - 1].isspace() and text[: found[k].start()].rstrip()[-1:] in ".:" and text[: found[k].start()].strip())]

    def score(at: int) -> tuple[int, int]:
        seen, total, first, last = set(), 0, None, 0
        for o, i in hits:
            if at <= o < at + width:
                total += 1 if i in seen else 1000
                seen.add(i)
                first = o if first is None else first
                last = o + len(phrases[i])
        middle = 0 if first is None else first - int((width - (last - first)) / 2)
        return total, max(0, min(middle, n - width))

    best, start = 0, 0
    for o, _ in hits:
        value, centred = score(o)
        if value > best:
            best, start = value, centred
        if n > width:
            s = max((k for k in starts if k <= o), default=0)
            if s < o:
                value = score(s)[0] + (120 if s == 0 else 100)
                if value > best:
                    best, start = value, s
    end = min(n, start + width)
    a = 0 if start == 0 else found[start].start()
    b = len(text) if end == n else found[end - 1].end()
    marks: list[list[int]] = []
    for o, i in hits:
        if start <= o and o + len(phrases[i]) <= end:
            s, e = found[o].start(), found[o + len(phrases[i]) - 1].end()
            if marks and s <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], e)
            else:
                marks.append([s, e])
    out, at = [], a
    for s, e in marks:
        out += [text[at:s], "<mark>", text[s:e], "</mark>"]
        at = e
    return ("..." if start else "") + "".join(out) + text[at:b] + ("..." if end < n else "")


def search(sessions: DataFrame, index: DataFrame, stats: DataFrame, query: str, limit: int = 20, analysis: Analysis = Analysis(), column: str = "user_messages") -> DataFrame:
    """The best sessions for a query: id, project, title, start, duration, branch, snippet and rank.

    sessions may be filtered before; statistics are the corpus's. Ties go by id. Snippets are made
    for the rows of the result only.
    """
    top = ranked(index, stats, query, analysis).join(sessions, "session_uuid").orderBy("rank", "session_uuid").limit(min(100, max(1, limit)))
    return shown(top, query, analysis, column)


def shown(top: DataFrame, query: str, analysis: Analysis = Analysis(), column: str = "user_messages") -> DataFrame:
    """Sessions with their rank as a result shows them, with a snippet of a column."""
    phrases = phrases_of(query, analysis)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, phrases, analysis))

    return top.select("session_uuid", "project_name", "ai_title", "started_at", "duration_secs", "git_branch", cut(column).alias("snippet"), "rank")
