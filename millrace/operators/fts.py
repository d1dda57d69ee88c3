"""Full-text search: postings, a query language with AND OR NOT, phrases, fuzzy terms, ranges, fields, boosts; BM25."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import INVAL, NOTFOUND, EngineError
from millrace.functions.text import tokens
from millrace.operators.postings import ordered
from millrace.sources.shared import Files, materialize

K1, B = 1.2, 0.75
TOKEN = re.compile(r'\s*(?:(?P<field>[^\s":\[\]^~]+):)?(?:"(?P<phrase>[^"]*)"?|\[(?P<low>\S+)\s+TO\s+(?P<high>[^\s\]]+)\s*\]?|(?P<word>[^\s"\[\]^~:]+))(?P<suffix>(?:\^[0-9.]+|~[0-9]*)*)', re.I)


@dataclass(frozen=True)
class Clause:
    kind: str
    text: tuple[str, ...]
    field: str | None = None
    boost: float = 1.0
    edits: int = 0


@dataclass
class Parsed:
    """groups: any must hold; in a group (positive, clause number) all must."""

    clauses: list[Clause] = field(default_factory=list)
    groups: list[list[tuple[bool, int]]] = field(default_factory=list)


def parse(query: str) -> Parsed:
    """AND and NOT bind to the clause before; OR and mere neighbourhood start a group.  An operator that comes first is a word."""
    out, joined, at = Parsed(), None, 0
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        word = m["word"]
        if word and not m["field"] and not m["suffix"] and out.clauses and word.upper() in ("AND", "OR", "NOT"):
            joined = word.upper()
            continue
        boost, edits, cut = 1.0, None, False
        for s in re.findall(r"\^[0-9.]+|~[0-9]*", m["suffix"] or ""):
            if s[0] == "~":
                edits, cut = int(s[1:] or 1), True
            elif not cut:  # a boost after ~ is lost
                boost = float(s[1:]) if re.fullmatch(r"\d+\.?\d*|\.\d+", s[1:]) else 1.0
        if m["phrase"] is not None:
            c = Clause("phrase", (m["phrase"],), m["field"], boost)
        elif m["low"]:
            c = Clause("range", (m["low"].lower(), m["high"].lower()), m["field"], boost)
        elif edits is not None:
            c = Clause("fuzzy", (word,), m["field"], boost, edits)
        else:
            c = Clause("term", (word,), m["field"], boost)
        out.clauses.append(c)
        n = len(out.clauses) - 1
        if joined in ("AND", "NOT") and out.groups:
            out.groups[-1].append((joined == "AND", n))
        else:
            out.groups.append([(True, n)])
        joined = None
    return out


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when((df <= 0) | (n <= 0), 0.0).otherwise(idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl)))


def _postings(places: DataFrame) -> DataFrame:
    return places.groupBy("term", "doc_id", "field", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


class TextIndex:
    """postings: (term, doc_id, field, tf, dl, positions); docs: (doc_id, field, ts, dl) where they are neither stored nor
    kept; texts: docs where the postings come from them."""

    def __init__(self, docs: DataFrame | None, postings: DataFrame, stats: DataFrame, options: dict, texts: DataFrame | None = None):
        self.docs, self.postings, self.stats, self.options, self.texts = docs, postings, stats, options, texts

    @classmethod
    def build(cls, df: DataFrame, key: str, columns: list[str], stemming: bool = False, stopwords: list[str] | None = None, language: str = "english", persist: bool = False) -> TextIndex:
        """One shuffle by (term, document), combined before it; persist keeps the postings for many searches."""
        if language not in ("english", "none"):
            raise EngineError(INVAL, language)
        options = {"stemming": stemming, "stopwords": stopwords}
        fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), tokens(F.col(c), **options).alias("ts")) for c in columns]))
        docs = df.select(F.col(key).alias("doc_id"), fields.alias("f")).select("doc_id", "f.field", "f.ts", F.size("f.ts").alias("dl"))
        postings = _postings(docs.select("doc_id", "field", "dl", F.posexplode("ts").alias("pos", "term")))
        return cls(None, postings.persist(), _stats(docs), options, docs) if persist else cls(docs, postings, _stats(docs), options, docs)

    def drop(self) -> None:
        self.postings.unpersist()

    def save(self, path: str) -> TextIndex:
        """Writes postings in the order of terms, so that a search reads the row groups of its terms, and the statistics."""
        spark = self.postings.sparkSession
        self.stats.coalesce(1).write.parquet(f"{path}/stats")
        if self.texts is None:  # stored postings, in order already
            posts = self.postings
        else:
            posts = ordered(self.texts, spark.read.schema(self.stats.schema).parquet(f"{path}/stats").collect(), self.postings.schema)
        posts.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        Files(spark, path).write("index.json", {"options": self.options, "postings": self.postings.schema.jsonValue(), "stats": self.stats.schema.jsonValue()})
        return TextIndex.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> TextIndex:
        files = Files(spark, path)
        if not files.exists("index.json"):
            raise EngineError(NOTFOUND, path)
        m = files.read("index.json")
        read = lambda x: spark.read.schema(T.StructType.fromJson(m[x])).parquet(f"{path}/{x}")
        return cls(None, read("postings"), read("stats"), m["options"])

    def vocabulary(self) -> DataFrame:
        return self.postings.select("term").distinct()

    def prefix(self, prefix: str) -> DataFrame:
        return self.vocabulary().where(F.col("term").startswith(prefix)).orderBy("term")

    def fuzzy(self, term: str, edits: int) -> DataFrame:
        return self.vocabulary().where(self._near(F.col("term"), term, edits)).orderBy("term")

    @staticmethod
    def _near(own: Column, term: str, edits: int) -> Column:
        return (F.abs(F.length(own) - len(term)) <= edits) & (F.levenshtein(own, F.lit(term), edits) >= 0)

    def _of(self, wanted: Callable[[Column], Column], exact: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Postings of the wanted terms, and statistics.

        Of stored or kept postings the filter reaches the scan.  Else texts are read and tokenized once: each row's length
        and its wanted tokens are written, and both come from those.
        """
        if self.docs is None:
            return self.postings.where(wanted(F.col("term"))), self.stats
        tokens_ = F.transform("ts", lambda t, k: F.struct(t.alias("term"), k.alias("pos")))
        own = F.filter(tokens_, lambda x: wanted(x["term"]))
        if exact:  # only texts that have one of the words are looked at word by word
            own = F.when(F.arrays_overlap("ts", F.array(*map(F.lit, exact))), own)
        few = materialize(self.docs.select("doc_id", "field", "dl", own.alias("ts")), "fts-hits")
        return _postings(few.select("doc_id", "field", "dl", F.explode("ts").alias("t")).select("doc_id", "field", "dl", "t.term", "t.pos")), _stats(few)

    def _words(self, text: str) -> list[str]:
        """Query words go through the index's own tokenizer, on the driver."""
        o = self.options
        words = [w[:255] for w in re.findall(r"[a-z0-9']+", "".join(c.lower() if c.isascii() else c for c in text))]
        words = [w for w in words if w not in (o["stopwords"] or ())]
        return [w for w in (map(_stem, words) if o["stemming"] else words) if len(w) >= 2]

    def search(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(doc_id, score): one aggregate by document whatever the query; each clause is a flag in it."""
        parsed = parse(query)
        parts: list[tuple[int, int, Column, Callable]] = []
        sizes: dict[int, int] = {}
        for i, c in enumerate(parsed.clauses):
            here = F.lit(True) if c.field is None else F.col("field") == c.field
            if c.kind == "range":
                conds = [lambda t, c=c: t.between(*c.text)]
            elif c.kind == "fuzzy":
                conds = [lambda t, w=w, c=c: self._near(t, w, c.edits) for w in self._words(c.text[0])[:1]]
            else:
                conds = [lambda t, w=w: t == w for w in self._words(c.text[0])]
            sizes[i] = len(conds)
            parts += [(i, j, here, x) for j, x in enumerate(conds)]
        if not parts:
            return self.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        term = F.col("term")
        exact = sorted({w for c in parsed.clauses for w in self._words(c.text[0])}) if all(c.kind in ("term", "phrase") for c in parsed.clauses) else None
        postings, stats = self._of(lambda t: reduce(lambda p, q: p | q, [x(t) for *_, x in parts]), exact)
        matched = F.filter(F.array(*[F.when(h & x(term), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j, h, x in parts]), lambda s: s.isNotNull())
        places = "positions" if any(c.kind == "phrase" and sizes[i] > 1 for i, c in enumerate(parsed.clauses)) else F.lit(None).alias("positions")
        hits = postings.select("doc_id", "term", "field", "tf", "dl", places, F.explode(matched).alias("c"))
        df = hits.groupBy("field", "term", "c").agg(F.count("*").alias("df"))
        # Two rows per field and matched term: a few for words, the matched vocabulary for ranges; AQE chooses the join.
        scored = hits.join(df, ["field", "term", "c"]).join(F.broadcast(stats), "field")
        boosts = F.element_at(F.array(*[F.lit(c.boost) for c in parsed.clauses]), F.col("c.i") + 1)
        scored = scored.withColumn("s", boosts * bm25(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("avgdl"), F.col("n").cast("double"), F.col("df").cast("double"), k1, b))
        aggs = []
        for i, j, *_ in parts:
            own = (F.col("c.i") == i) & (F.col("c.j") == j)
            aggs += [F.sum(F.when(own, F.col("s"))).alias(f"s_{i}_{j}")]
            if parsed.clauses[i].kind == "phrase" and sizes[i] > 1:
                aggs += [F.collect_list(F.when(own, F.struct("field", "positions"))).alias(f"p_{i}_{j}")]
        by = scored.groupBy("doc_id").agg(*aggs)
        holds, scores = [], []
        for i, c in enumerate(parsed.clauses):
            every = [F.col(f"s_{i}_{j}") for j in range(sizes[i])]
            if not every:
                holds.append(F.lit(False))
            elif c.kind == "phrase" and len(every) > 1:
                holds.append(_adjacent([F.col(f"p_{i}_{j}") for j in range(sizes[i])]))
            else:
                holds.append(reduce(lambda x, y: x & y, [x.isNotNull() for x in every]))
            scores.append(F.when(holds[-1], reduce(lambda x, y: x + y, [F.coalesce(x, F.lit(0.0)) for x in every], F.lit(0.0))).otherwise(0.0))
        ok = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [holds[n] if p else ~holds[n] for p, n in g]) for g in parsed.groups])
        positive = {n for g in parsed.groups for p, n in g if p}
        return by.where(ok).select("doc_id", reduce(lambda x, y: x + y, [scores[n] for n in sorted(positive)], F.lit(0.0)).alias("score"))


def _adjacent(lists: list[Column]) -> Column:
    """Whether some place of the first token has all others right behind it, in the same field."""

    def then(j: int, field_: Column, place: Column) -> Column:
        return F.exists(lists[j], lambda o: (o["field"] == field_) & F.array_contains(o["positions"], place + j))

    def starts(o: Column) -> Column:
        return F.exists(o["positions"], lambda place: reduce(lambda x, y: x & y, [then(j, o["field"], place) for j in range(1, len(lists))]))

    return F.exists(lists[0], starts)


def _stem(w: str) -> str:
    for s in ("ing", "ed", "ly", "es", "s", "er", "or"):
        if w.endswith(s):
            r = w[: len(w) - len(s)]
            return w if len(r) < 3 else r[:-1] if r[-1] == r[-2] and r[-1].isalpha() else r
    return w
