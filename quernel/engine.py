"""Entry points over a corpus: index, search, ask, lint. Each takes and returns DataFrames; ``python -m quernel`` is the same as a command."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import detect_lang, script_ratio, tokenize
from .operators import bm25, dense, fusion, governance, seams, sections
from .operators.postings import Index
from .sources import corpus

SUBDIRS = ["entities", "concepts", "qa"]


class Engine:
    """A corpus of Markdown pages below ``root`` (folders entities, concepts, qa) and an index in ``store``."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store.rstrip("/")

    # -- building

    def files(self) -> DataFrame:
        return sections.with_frontmatter(corpus.in_corpus_order(corpus.scan_markdown(self.spark, self.root, SUBDIRS)))

    def pages(self) -> DataFrame:
        """Pages with their frontmatter's fields, as the governance checks take them."""
        fm = lambda k, kind: F.expr(f"try_variant_get(parse_json(frontmatter), '$.{k}', '{kind}')")
        empty = F.expr("CAST(array() AS array<string>)")
        return self.files().select(
            F.regexp_replace("name", r"\.md$", "").alias("slug"), "dir", fm("status", "string").alias("status"), fm("updated", "string").alias("updated"), F.coalesce(fm("sources", "array<string>"), empty).alias("sources"),
            F.coalesce(fm("aliases", "array<string>"), empty).alias("aliases"), "body", fm("grounding_failure.reason", "string").alias("reason"), fm("count", "int").alias("count"), F.col("frontmatter").alias("fm"),
        )

    def admitted(self, files: DataFrame) -> DataFrame:
        """Pages that may be indexed: none whose grounding failed, answers only while live."""
        status = F.expr("try_variant_get(parse_json(frontmatter), '$.status', 'string')")
        return files.where(~F.coalesce(status == "failed_grounding", F.lit(False)) & ((F.col("dir") != "qa") | F.coalesce(status == "live", F.lit(False))))

    def index(self) -> DataFrame:
        """Parse, tokenise, embed and write the index; returns its statistics."""
        files = self.admitted(self.files()).withColumn("stem", F.regexp_replace("name", r"\.md$", ""))
        rows = sections.with_tokens(sections.sections(files, "stem"))
        fm = files.select(F.col("stem").alias("name"), F.col("seq").alias("file_seq"), "dir", F.when(F.col("dir") == "qa", tokenize(F.expr("try_variant_get(parse_json(frontmatter), '$.question', 'string')"))).alias("q"))
        rows = rows.join(fm, "name").withColumn("question_tokens", F.coalesce("q", F.expr("CAST(array() AS array<string>)")))
        rows = rows.select(
            "id", F.col("name").alias("file"), (F.col("file_seq") * 1_000_000 + F.col("emit_seq")).alias("seq"), "heading", "heading_path", "content", F.concat("tokens", "question_tokens").alias("tokens"), "question_tokens",
            F.coalesce(F.when(F.trim("content") != "", detect_lang("content")), detect_lang("heading")).alias("lang"), F.col("dir").alias("page_type"), seams.embed(F.concat_ws(" ", "heading", "content")).alias("embedding"),
        )
        rows.write.mode("overwrite").parquet(f"{self.store}/sections")
        rows = self.sections()
        new = f"{self.store}/index-{uuid.uuid4().hex}"
        Index.build(rows.drop("embedding", "content", "heading"), new)
        corpus.move_in(self.spark, new, f"{self.store}/index")
        stats = bm25.corpus_stats(rows)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.store}/stats")
        return self.spark.read.parquet(f"{self.store}/stats")

    def sections(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/sections")

    # -- asking

    def search(self, queries: DataFrame, k: int = 10, exclude_qa: bool = False) -> DataFrame:
        """(query_id, id, rank, score): each query over the sections of its language; k from 1 to 10."""
        k, index = max(1, min(10, k)), Index(self.spark, [f"{self.store}/index"])
        asked = queries.select("query_id", "text", detect_lang("text").alias("lang"))
        found = None
        for lang in bm25.THRESHOLD:
            keep = F.col("lang") == lang
            part = index.search(asked.where(keep), k, keep & (F.col("page_type") != "qa") if exclude_qa else keep)
            found = part if found is None else found.unionByName(part)
        return found

    def hybrid(self, queries: DataFrame, k: int = fusion.TOP) -> DataFrame:
        """(query_id, id, score, rank, passed): both arms, fused, behind the either-arm gate."""
        lexical = self.search(queries, 10)
        asked = queries.select(F.col("query_id").cast("long"), seams.embed("text").alias("vector"))
        ids = self.sections().select("seq", "id")
        near = dense.nearest(asked, self.sections(), fusion.DEPTH, id_col="seq").withColumnRenamed("id", "seq").join(ids, "seq").select("query_id", "id", "rank", "distance")
        fused = fusion.fuse(lexical, near, k)
        tops = queries.select("query_id").join(lexical.groupBy("query_id").agg(F.max("score").alias("bm25_top")), "query_id", "left").join(near.groupBy("query_id").agg(F.min("distance").alias("dense_best")), "query_id", "left")
        return fused.join(fusion.either_gate(tops, bm25.THRESHOLD["en"], dense.CEILING).select("query_id", "passed"), "query_id")

    def ask(self, queries: DataFrame, draft=seams.first_sentence, verify=seams.supported_by_words) -> DataFrame:
        """(query_id, answer, passed, reason, sources): retrieved, gated by the question's main script, drafted, verified."""
        hits = self.search(queries, 3)
        limit = F.when(script_ratio("text") >= 0.5, bm25.THRESHOLD["zh"]).otherwise(bm25.THRESHOLD["en"])
        text = self.sections().select("id", "content")
        found = hits.join(text, "id").groupBy("query_id").agg(F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct("rank", "id", "content"))).alias("x"))
        gated = queries.join(found, "query_id", "left").withColumn("open", F.coalesce(F.col("top") >= limit, F.lit(False)))
        texts = F.when(F.col("open"), F.transform("x", lambda x: x["content"]))
        done = seams.answer(gated.select("query_id", F.col("text").alias("question"), texts.alias("sections")), draft, verify)
        rows = done.join(gated.select("query_id", "top", F.transform("x", lambda x: x["id"]).alias("sources")), "query_id")
        reason = F.when((F.col("reason") == "retrieval_empty") & F.col("top").isNotNull(), "below_threshold").otherwise(F.col("reason"))
        return rows.select("query_id", "answer", "passed", reason.alias("reason"), "sources")

    # -- governing

    def lint(self, docs: DataFrame, log: DataFrame | None = None) -> dict[str, DataFrame]:
        """The findings of each check; ``docs``: path, basename, content, modified."""
        p = self.pages().withColumn("hashes", F.lit(None).cast("map<string,string>"))
        out = {
            "C2": governance.red_links(p), "C3": governance.failed_grounding(p, docs), "C4": governance.collisions(p), "C5": governance.contradictions(p), "C6": governance.stale_pages(p, docs),
            "C8": governance.promotion_candidates(p), "C9": governance.stale_answers(p), "C10": governance.invalid_answers(p), "C11": governance.orphans(p, docs), "C12": governance.alias_collisions(p),
        }
        if log is not None:
            out["C1"] = governance.coverage_gaps(governance.parse_log(log))
        return out

    def report(self, docs: DataFrame, log: DataFrame | None = None) -> str:
        """The checks' counts by axis, as Markdown; eleven rows at most come to the driver."""
        rows = governance.summary(self.lint(docs, log)).orderBy("place").collect()
        out = ["# Corpus report"]
        for axis in dict.fromkeys(r.axis for r in rows):
            out += ["", f"## {axis}", *(f"- {r.check_id} {r.label}: {r.n}" for r in rows if r.axis == axis)]
        return "\n".join(out)

    def catalogue(self) -> DataFrame:
        """(dir, bullets, listing): the pages of each folder as a Markdown list."""
        bullet = F.concat(F.lit("- [["), "slug", F.lit("]]"))
        rows = self.pages().groupBy("dir").agg(F.count("*").alias("bullets"), F.array_sort(F.collect_list(F.struct("slug", bullet.alias("b")))).alias("x"))
        return rows.select("dir", "bullets", F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("listing"))

    def page_of(self, hits: DataFrame) -> DataFrame:
        """All sections of each hit's page, pages by their first hit."""
        return fusion.expand_pages(hits, self.sections())

    def first_hits(self, hits: DataFrame) -> DataFrame:
        """The best hit of each query."""
        return hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("_r = 1").drop("_r")
