"""Questions to one corpus or several: parse on the driver, one lazy plan, a limited list back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, dense, fuse, index, literal

MODES = ("auto", "lexical", "semantic")
#: An encoder turns texts into unit vectors.
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class Corpus:
    """A package's tables, ready for questions.

    passages: doc_id, position, text and, if already made, norm, tokens and length; documents: doc_id, name,
    pseudopath, source; vectors, if any: doc_id, position, vector.
    """

    def __init__(self, documents: DataFrame, passages: DataFrame | None = None, vectors: DataFrame | None = None, encoder: Encoder | None = None, language: str | None = None, splitter: str = "blank_line"):
        parts = passages if passages is not None else index.passages(documents.select("doc_id", "text"), splitter)
        self.documents, self.vectors, self.encoder, self.language = documents, vectors, encoder, language
        self.passages = parts if "tokens" in parts.columns else index.tokenized(parts)

    def _of(self, only: str | None) -> DataFrame:
        about = self.documents.select("doc_id", "name", "pseudopath", "source")
        return about if only is None else about.filter(F.col("source") == only.upper())

    def rank_passages(self, query: str, context: int = 1, only: str | None = None, limit: int = 12, minimum_terms: int = 2, glossary: Mapping[str, list[str]] | None = None) -> DataFrame:
        """Passages with enough of the query's terms; statistics are those of the filtered documents."""
        terms = T.query_terms(query, None, glossary)
        about = self._of(only)
        parts = self.passages.join(about.select("doc_id"), "doc_id", "left_semi") if only else self.passages
        hits = bm25.document_scores(bm25.scored(parts, terms, minimum_terms), len(set(terms)))
        top = bm25.interleaved(hits, limit).withColumn("passage", T.trim_table(F.col("text"), F.get("terms", F.lit(0))))
        near = self.passages.join(F.broadcast(top.select("doc_id").distinct()), "doc_id")  # at most `limit` documents
        around = literal.with_context(near.select("doc_id", "position", "text"), context).drop("text")
        found = top.join(around, ["doc_id", "position"]).join(about, "doc_id")
        return found.select("doc_id", "name", "pseudopath", "source", "position", "text", "passage", "context", "score", "terms", "rank", "doc_score").orderBy("rank", F.desc("doc_score"), "doc_id")

    def search_literal(self, phrase: str, only: str | None = None, limit: int = 12) -> DataFrame:
        hits = literal.literal_hits(self.passages, phrase).join(self._of(only), "doc_id").orderBy("doc_id", "position").limit(limit)
        return hits.select("doc_id", "name", "pseudopath", "source", "position", "text")

    def search(self, query: str, only: str | None = None, limit: int = 12, context: int = 1) -> DataFrame:
        """Ranked passages; if the query is a specific phrase, its literal hits come first."""
        ranked = self.rank_passages(query, context, only, limit)
        columns = ["doc_id", "name", "pseudopath", "source", "position", "text"]
        ranked = fuse.placed(ranked, [F.col("rank"), F.desc("doc_score"), F.col("doc_id")], 1).select(*columns, "place")
        phrase = T.literal_phrase(query)
        if phrase is None:
            return ranked.orderBy("place")
        hits = fuse.placed(self.search_literal(phrase, only, limit), [F.col("doc_id"), F.col("position")], 0).select(*columns, "place")
        return literal.literal_first(hits, ranked).orderBy("engine", "place").limit(limit)

    def lexical(self, query: str, limit: int = 8, only: str | None = None, glossary: Mapping[str, list[str]] | None = None) -> DataFrame:
        """Statistics of the whole corpus, function words of its language only, documents with the phrase first."""
        phrase = T.literal_phrase(query)
        terms = T.query_terms(phrase or query, self.language, glossary)
        about = self._of(only)
        hits = bm25.scored(self.passages, terms, 1, 60.0).join(about, "doc_id")
        ranked = bm25.document_scores(hits, len(set(terms)))
        preferred = None
        if phrase:
            ranked = ranked.join(literal.preferred_documents(literal.literal_hits(self.passages, phrase)), "doc_id", "left")
            preferred = F.col("preferred")
        return bm25.interleaved(ranked, limit, preferred)

    def semantic(self, query: str, limit: int = 8, only: str | None = None) -> DataFrame:
        if self.vectors is None or self.encoder is None:
            raise ValueError("this corpus has no vectors or no encoder")
        (asked,) = self.encoder([query])
        near = dense.nearest(self.vectors.join(self._of(only).select("doc_id"), "doc_id", "left_semi"), asked, limit, "doc_id")
        return near.join(self.passages.select("doc_id", "position", "text"), ["doc_id", "position"]).join(self._of(only), "doc_id")

    def query(self, query: str, limit: int = 8, only: str | None = None, mode: str = "auto") -> DataFrame:
        """Lexical and dense lists, three times as long as asked, fused by reciprocal rank; auto takes what there is."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        able = self.vectors is not None and self.encoder is not None
        columns = ["doc_id", "name", "pseudopath", "source", "position", "text"]
        if mode == "semantic":
            found = self.semantic(query, limit, only).select(*columns, "score") if able else self.passages.join(self._of(None), "doc_id").select(*columns, F.lit(0.0).alias("score")).limit(0)
            return found.orderBy(F.desc("score"), "doc_id")
        if mode == "lexical" or not able:
            return self.lexical(query, limit, only).select(*columns, "score", "terms", "doc_score", "rank")
        words = fuse.placed(self.lexical(query, 3 * limit, only), [F.col("rank"), F.desc("doc_score"), F.col("doc_id")], 0)
        near = fuse.placed(self.semantic(query, 3 * limit, only), [F.desc("score"), F.col("doc_id")], 1)
        both = words.select(*columns, "place", "list_id").unionByName(near.select(*columns, "place", "list_id")).withColumn("key", F.substring("text", 1, 120))
        ranks = fuse.fuse(both, ("doc_id", "key"))
        first = literal.first_of_each(both, [F.col("list_id"), F.col("place")], 120).drop("place", "list_id")
        return first.withColumnRenamed("position", "passage").join(ranks, ["doc_id", "key"]).drop("key").orderBy("position").limit(limit)

    def language_mismatch(self, query: str) -> str | None:
        """A hint if no term of the query stands in the corpus and its language is another one."""
        terms = T.query_terms(query, self.language)
        if not terms or self.passages.filter(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms]))).limit(1).count():
            return None
        asked = T.detect_language_of(query)[0]
        if asked is not None and asked == self.language:
            return None
        return f"the corpus is in {self.language or 'an unknown language'} and holds none of the query's words" + (f", which are in {asked}" if asked else "")

    def info(self) -> dict:
        return {"documents": self.documents.count(), "passages": self.passages.count(), "language": self.language, "vectors": self.vectors is not None}

    def document(self, name: str) -> str | None:
        """The whole text of the document of this name or pseudopath."""
        wanted = self.documents.filter((F.col("name") == name) | (F.col("pseudopath") == name)).select("doc_id").orderBy("doc_id").limit(1)
        parts = self.passages.join(F.broadcast(wanted), "doc_id").select("position", "text").orderBy("position").collect()  # one document
        return "\n\n".join(r["text"] for r in parts) + "\n" if parts else None


def search_packages(packages: Mapping[str, Corpus], query: str, limit: int = 5, only: str | None = None) -> DataFrame:
    """Each package answers on its own; the answers are fused. With vectors everywhere, far packages aren't asked."""
    asked = dict(packages)
    if len(asked) > 1 and all(p.vectors is not None and p.encoder is not None for p in asked.values()):
        near = None
        for name, p in asked.items():
            (vector,) = p.encoder([query])
            one = dense.package_nearness(p.vectors.withColumn("package", F.lit(name)), vector)
            near = one if near is None else near.unionByName(one)
        keep = {r["package"] for r in dense.gate(near).collect()}  # one row per package
        asked = {name: p for name, p in asked.items() if name in keep}
    lists = None
    for k, (name, p) in enumerate(asked.items()):
        hits = p.query(query, limit, only)
        order = [F.col("position")] if "passage" in hits.columns else [F.col("rank"), F.desc("doc_score"), F.col("doc_id")]
        one = fuse.placed(hits, order, k).select(F.lit(name).alias("package"), "doc_id", "name", "pseudopath", "source", "text", "place", "list_id")
        lists = one if lists is None else lists.unionByName(one)
    lists = lists.withColumn("key", F.substring("text", 1, 120))
    ranks = fuse.fuse(lists, ("package", "doc_id", "key"))
    first = literal.first_of_each(lists, [F.col("list_id"), F.col("place")], 120, ("package", "doc_id")).drop("place", "list_id")
    return first.join(ranks, ["package", "doc_id", "key"]).drop("key").orderBy("position").limit(limit)


def tool_search(packages: Mapping[str, Corpus], query: str, limit: int = 5, direction: str | None = None) -> dict:
    """The search tool's answer: limit from 1 to 20, an unknown direction ignored, a hint when nothing is found."""
    only = direction if direction and direction.upper() in ("SENT", "RECEIVED", "OTHER") else None
    rows = search_packages(packages, query, min(max(limit, 1), 20), only).collect()  # at most 20 rows
    found = [{"package": r["package"], "document": r["name"], "pseudopath": r["pseudopath"], "source": r["source"], "passage": r["text"], "score": r["score"]} for r in rows]
    answer = {"query": query, "found": len(found), "passages": found}
    if not found:
        hints = [h for p in packages.values() if (h := p.language_mismatch(query))]
        answer["hint"] = hints[0] if hints else "try other words"
    return answer


def tool_info(packages: Mapping[str, Corpus]) -> dict:
    each = {name: p.info() for name, p in packages.items()}
    languages = sorted({i["language"] for i in each.values() if i["language"]})
    # Only vectors find what a question in another language means.
    crossing = {"languages": languages, "questions_in_any_language": bool(each) and all(p.vectors is not None and p.encoder is not None for p in packages.values())}
    return {"packages": each, "documents": sum(i["documents"] for i in each.values()), "passages": sum(i["passages"] for i in each.values()), "cross_language": crossing}


def tool_document(packages: Mapping[str, Corpus], name: str) -> dict:
    for package, p in packages.items():
        if (text := p.document(name)) is not None:
            return {"package": package, "name": name, "text": text}
    return {"name": name, "error": "no such document"}
