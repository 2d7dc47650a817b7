"""The engine's tools over a store: bootstrap, ingest, remember, drain, reindex, search, query, lint."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import runtime
from quillmesh import schema as S
from quillmesh.functions import text as X
from quillmesh.operators import chunk, contradictions, duplicates, extraction, facts, graph, links, planning, repair, resolve, search
from quillmesh.providers import Extractive, HashEmbedder, Judge, Rules
from quillmesh.sources import fetch, html
from quillmesh.sources.store import Store, backup
from quillmesh.streaming import incremental, worklog

#: Sources and words an answer needs to be filed, characters of an excerpt and of a summary.
FILE_SOURCES, FILE_WORDS, EXCERPT, SUMMARY = 3, 100, 1000, 4000


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    embedder: HashEmbedder
    synthesizer: Extractive
    judge: Judge = field(default_factory=Rules)
    fetcher: Callable[[DataFrame], DataFrame] = lambda urls: fetch.fetch(urls, "source")
    reader: Callable = fetch.by_pypdf
    budget: int = 6000

    @classmethod
    def at(cls, spark: SparkSession, root: str, dim: int = 64) -> Engine:
        return cls(spark, Store(spark, root), HashEmbedder(dim), Extractive())

    def _log(self, space: str, action: str, subject: str, now: str, created: int = 0, updated: int = 0, notes: str = "") -> None:
        row = self.spark.createDataFrame([(space, action, X.fold_text(subject)[:200], created, updated, notes)], "space_id string, action string, subject string, created long, updated long, notes string")
        self.store.append("log", row.withColumn("at", F.lit(now).cast("timestamp")))

    def bootstrap(self, space: str, now: str) -> dict[str, list[str]]:
        """Records the space's schema version; gives the properties its types are to have. Idempotent; a newer store is refused."""
        seen = [r["notes"] for r in self.store.read("log").filter((F.col("space_id") == space) & (F.col("action") == "bootstrap")).select("notes").collect()]
        number = lambda v: [int(x) for x in v.split(".")]
        if seen and max(map(number, seen)) > number(S.SCHEMA_VERSION):
            raise ValueError("the store is of a newer schema")
        if S.SCHEMA_VERSION not in seen:
            self._log(space, "bootstrap", space, now, notes=S.SCHEMA_VERSION)
        return S.missing_properties({})

    @staticmethod
    def outbound() -> Column:
        return S.outbound()

    def narrate(self, space: str, note: str | None, now: str) -> DataFrame:
        """The source object of narrated knowledge: its type by the note's words, an excerpt of it, or its own name without one."""
        row = self.spark.createDataFrame([(space, note or "")], "space_id string, note string")
        clean = X.scrub_text_urls(F.col("note"))
        row = row.withColumn("name", F.when(F.col("note") == "", F.lit(f"agent {now[:10]}")).otherwise(F.substring(clean, 1, 200)))
        kind = F.when(F.lower("note").contains("conversation"), "conversation").otherwise("agent")
        row = row.withColumn("id", X.uuid5(F.concat_ws(":", "space_id", F.lit("narration"), "name", F.lit(now)))).withColumn("properties", F.array().cast(f"array<{S.PROPERTY}>"))
        row = row.withColumn("properties", S.with_property("wiki_excerpt", "text", F.when(F.col("note") == "", F.col("name")).otherwise(F.substring(X.strip_controls(clean), 1, 500))))
        row = row.withColumn("properties", S.with_property("wiki_ingested_at", "date", F.lit(now))).withColumn("properties", S.with_property("wiki_source_type", "select", F.struct(kind.alias("id"), kind.alias("name"))))
        made = row.select("space_id", "id", "name", F.lit("wiki_source").alias("type_key"), "properties", F.lit("").alias("markdown"), F.lit(False).alias("archived"), F.lit(now).cast("timestamp").alias("created_date"), F.lit(now).alias("last_modified"), F.array().cast("array<string>").alias("backlinks"))
        self.put(made)
        return made

    def backfill(self, now: str) -> bool:
        """Fills the points' payload from their objects, once for a version of the schema; the mark is written only after it is done. Whether it ran."""
        mark = f"payload {S.SCHEMA_VERSION}"
        if not self.store.read("log").filter(F.col("notes") == mark).isEmpty():
            return False
        points, objects = self.store.read("points"), self.store.read("objects").select("space_id", F.col("id").alias("object_id"), *S.payload())
        for column in ("source_type", "domain_tags", "wiki_url"):
            points = incremental.backfill(points, objects.select("space_id", "object_id", column), column)
        self.store.replace("points", points)
        self._log("", "backfill", "points", now, notes=mark)
        return True

    def put(self, objects: DataFrame) -> None:
        """Creates or replaces objects by (space_id, id)."""
        self.store.upsert("objects", objects, ["space_id", "id"])

    def candidates(self, pages: DataFrame) -> DataFrame:
        """(space_id, source_id, name, facts, ord): a candidate a heading of level 1 or 2 with the text under it; without any the page itself."""
        parts = pages.select("space_id", "source_id", "fallback", F.posexplode(F.split("markdown", r"(?m)^(?=#{1,2}\s+.)")).alias("ord", "p"))
        name = F.regexp_extract("p", r"^#{1,2}\s+(.+)", 1)
        headed = F.col("p").rlike(r"^#{1,2}\s+.")
        made = parts.select("space_id", "source_id", "ord", F.when(headed, name).otherwise(F.col("fallback")).alias("raw"), chunk.trimmed(F.when(headed, F.regexp_replace("p", r"^#{1,2}\s+.+", "")).otherwise(F.col("p"))).alias("facts"))
        return made.withColumn("name", X.sanitize_name(F.col("raw"))).filter("name IS NOT NULL AND facts <> ''").filter(~X.identifier_like(F.col("name"))).drop("raw")

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written once under the store, so that what a model or an address told is not asked again."""
        batch = f"{self.store.root}/ingests/{uuid.uuid4().hex}"
        df.write.parquet(batch)
        return self.spark.read.parquet(batch)

    def _merged(self, told: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
        """What is told (space_id, type_key, name, ord, label, source_id, facts) resolved and merged by source into the objects there are.

        (space_id, id, name, type_key, properties, created): the objects as they are to be, with their conflicts and those of
        the peers they contradict (created is null for a peer that nothing was told of); and (step, note, n): what was degraded.
        With dry_run no conflicts are looked for.
        """
        by = ["space_id", "type_key"]
        live = self.store.read("objects").filter(F.col("type_key").isin(*S.FACTS_KEY) & ~F.coalesce("archived", F.lit(False)))
        told = self._kept(told.withColumn("k", X.normalize_title(F.col("name"))))
        fresh = self._kept(told.groupBy(*by, "k").agg(F.min("name").alias("name"), F.min_by("facts", F.struct("ord", "label", "facts")).alias("facts")))
        titles = self._kept(live.select(*by, "id", "name", X.normalize_title(F.col("name")).alias("k")))
        named = fresh.join(resolve.resolved(fresh, titles, by, self.judge), [*by, "k"]).withColumn("id", F.coalesce("known", X.uuid5(F.concat_ws(":", *by, "k"))))
        told = self._kept(told.join(named.select(*by, "k", "id", F.col("name").alias("new_name")), [*by, "k"]))
        merged = self._kept(facts.merge_facts(live.select("id", S.knowledge().alias("text")), told.select("id", "ord", "label", "source_id", "facts"), extraction.consolidation(self.judge)))
        base = live.select("space_id", "id", F.col("name").alias("old_name"), F.col("properties").alias("had"))
        linked = told.groupBy(*by, "id").agg(F.min("new_name").alias("new_name"), F.array_sort(F.collect_set("source_id")).alias("new_sources"))
        rows = linked.join(merged, "id").join(base, ["space_id", "id"], "left").withColumn("properties", F.coalesce("had", F.array().cast(f"array<{S.PROPERTY}>")))
        rows = rows.withColumn("name", F.coalesce("old_name", "new_name")).withColumn("created", F.col("had").isNull())
        rows = rows.withColumn("properties", S.with_property("wiki_sources", "objects", F.array_union(S.relation_ids("wiki_sources"), "new_sources")))
        notes = merged.filter("degraded IS NOT NULL").select(F.lit("merge").alias("step"), F.col("degraded").alias("note"))
        shape = ["space_id", "id", "name", "type_key", "properties", "created"]
        if dry_run:
            return rows.select(*shape), notes
        checks, verdicts = self._conflicts(told, rows, live)
        mine = verdicts.join(checks.select("check_id", "id", "label"), "check_id")
        # A verdict on no section changes nothing, but a text without any would be lost in the join.
        marked = contradictions.marked(mine.join(merged.select("id", F.col("text")), "id").select("id", "text", "label", "source_id", "contradictions", "duplicates"), ["id"])
        rows = rows.join(marked.select("id", F.col("text").alias("_text"), "status"), "id", "left").withColumn("text", F.coalesce("_text", "text"))
        for kind, key in S.FACTS_KEY.items():
            rows = rows.withColumn("properties", F.when(F.col("type_key") == kind, S.with_property(key, "text", F.col("text"))).otherwise(F.col("properties")))
        review = F.struct(F.col("status").alias("id"), F.col("status").alias("name"))
        rows = rows.withColumn("properties", F.when(F.col("status").isNotNull(), S.with_property("wiki_status", "select", review)).otherwise(F.col("properties")))
        add = contradictions.peers(verdicts, checks.select("check_id", F.col("id").alias("obj_id")))
        others = live.select("space_id", "id", "name", "type_key", "properties", F.lit(None).cast("boolean").alias("created")).join(rows.select("space_id", "id"), ["space_id", "id"], "left_anti")
        both = rows.select(*shape).unionByName(others.join(add.select("id"), "id", "left_semi"))
        both = both.join(add.select("id", F.col("contradictions").alias("_add")), "id", "left")
        peers = S.with_property("wiki_contradictions", "objects", F.array_union(S.relation_ids("wiki_contradictions"), F.col("_add")))
        both = both.withColumn("properties", F.when(F.col("_add").isNotNull(), peers).otherwise(F.col("properties")))
        return both.select(*shape), notes.unionByName(verdicts.filter("error IS NOT NULL").select(F.lit("contradictions").alias("step"), F.col("error").alias("note")))

    def _conflicts(self, told: DataFrame, rows: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(check_id, space_id, id, source_id, label, new_facts, candidates) of what each source told of each object, held against the object's earlier sections and its linked peers; and the verdicts on them.

        Checks of one source are asked together, as many at a time as fit the budget.
        """
        per = told.groupBy("space_id", "id", "source_id", "label").agg(F.array_sort(F.collect_list(F.struct("ord", "facts"))).alias("f"))
        per = per.select("space_id", "id", "source_id", "label", F.array_join(F.transform("f", lambda x: x["facts"]), "\n").alias("new_facts"), F.concat_ws(":", "id", "source_id", "label").alias("check_id"))
        known = rows.select("space_id", "id", "name", "text", S.outbound().alias("outbound"), F.coalesce(F.nullif(self._told("had", "wiki_facts"), F.lit("")), self._told("had", "wiki_definition")).alias("old"))
        asked = per.join(known, ["space_id", "id"])
        own = contradictions.own_candidates(asked.withColumnRenamed("id", "obj_id"), ["check_id"])
        facing = asked.select("space_id", "check_id", F.col("id").alias("_self"), F.explode(F.array_distinct("outbound")).alias("id")).filter("id <> _self")
        facing = facing.join(live.select("space_id", "id", F.struct(F.col("id").alias("object_id"), F.col("name"), S.knowledge().alias("facts")).alias("peer")), ["space_id", "id"])
        peers = facing.groupBy("check_id").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
        checks = per.join(own, "check_id", "left").join(peers, "check_id", "left")
        none = F.array().cast(contradictions.OFFERED)
        checks = self._kept(checks.withColumn("candidates", F.concat(F.coalesce("peers", none), F.coalesce("own", none))).drop("own", "peers"))
        by = ["space_id", "source_id"]
        told_of = checks.filter(F.size("candidates") > 0).select(*by, "check_id", "new_facts", "candidates")
        return checks, self._kept(contradictions.judged(contradictions.batched(told_of, by, self.budget), self.judge, by))

    @staticmethod
    def _told(properties: str, key: str) -> Column:
        return F.coalesce(S.prop(key, properties)["text"], F.lit(""))

    def _put_made(self, rows: DataFrame, now: str) -> DataFrame:
        """Puts objects (space_id, id, name, type_key, properties, created) and gives (space_id, id, name, type_key, created) of just what was put."""
        made = self._kept(rows)  # written once, so that what is told is what was put
        fresh = made.drop("created").select("*", F.lit("").alias("markdown"), F.lit(False).alias("archived"), F.lit(now).cast("timestamp").alias("created_date"), F.lit(now).alias("last_modified"), F.array().cast("array<string>").alias("backlinks"))
        # What an object has beside its facts stays.
        had = self.store.read("objects").select("space_id", "id", F.struct("markdown", "created_date", "backlinks").alias("_had"))
        kept = fresh.join(had, ["space_id", "id"], "left").withColumns({c: F.coalesce(F.col("_had")[c], F.col(c)) for c in ("markdown", "created_date", "backlinks")})
        self.put(kept.drop("_had"))
        return made.select("space_id", "id", "name", "type_key", "created")

    def _fetched(self, sources: DataFrame) -> DataFrame:
        """sources (space_id, source, content) with error: addresses without content are asked for, under the guard of `fetch`; PDFs become the text of their pages."""
        sources = sources.select("space_id", "source", "content")
        absent = sources.filter("content IS NULL AND source IS NOT NULL")
        if absent.isEmpty():
            return sources.filter("content IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
        got = self._kept(self.fetcher(absent.select("space_id", "source")))
        is_pdf = F.coalesce(F.col("content_type").contains("application/pdf"), F.lit(False))
        pages = got.filter(~is_pdf | F.col("error").isNotNull()).select("space_id", "source", F.when(F.col("error").isNull(), F.decode("body", "UTF-8")).alias("content"), "error")
        read = fetch.pdf_result(fetch.pdf_pages(got.filter(is_pdf & F.col("error").isNull()).select("space_id", "source", F.col("body").alias("content")), ["space_id", "source"], self.reader))
        pdfs = read.select("space_id", "source", F.when(F.col("verdict").isNull(), F.col("markdown")).alias("content"), F.col("verdict").alias("error"))
        return self._kept(sources.filter("content IS NOT NULL").withColumn("error", F.lit(None).cast("string")).unionByName(pages).unionByName(pdfs))

    def ingest(self, sources: DataFrame, now: str, dry_run: bool = False) -> DataFrame:
        """Sources (space_id, source, content) to objects: main content, a source object each, headings and what the judge extracts as subjects,
        resolved by title, likeness or the judge, merged by source under the guards, and held against their earlier sections and linked peers.

        A source without content is fetched, if it is an address. Gives (space_id, id, name, type_key, created); created is null for sources
        and for peers that are contradicted. Unusable pages are left out; what was left out or degraded is counted in the log; with dry_run
        no object is written and no conflict looked for.
        """
        raw = self._fetched(sources).withColumn("is_html", X.looks_like_html(F.col("content")))
        lost = raw.filter("error IS NOT NULL").select(F.lit("fetch").alias("step"), F.col("error").alias("note"))
        raw = raw.filter("error IS NULL").drop("error")
        pages = html.extract(raw.select("space_id", "source", F.when(F.col("is_html"), F.col("content")).otherwise(F.lit("<p></p>")).alias("html"), "content", "is_html"))
        pages = pages.withColumn("markdown", F.when(F.col("is_html"), F.col("markdown")).otherwise(F.col("content"))).filter((~F.col("is_html") & (F.trim("content") != "")) | F.coalesce(F.col("verdict").isNull(), F.lit(False)))
        shown = X.scrub_credentials(F.col("source"))
        pages = pages.withColumn("source_id", X.uuid5(F.concat_ws(":", "space_id", shown))).withColumn("fallback", F.coalesce(F.nullif("title", F.lit("")), shown)).withColumn("shown", shown)
        pages = self._kept(pages.select("space_id", "source", "source_id", "shown", "fallback", "markdown"))
        by = ["space_id", "source_id"]
        answers = self._kept(extraction.projected(extraction.extract(pages, self.judge, by, "markdown", budget=4 * self.budget), "answer"))
        more = extraction.subjects(answers, by, "answer").withColumn("name", X.sanitize_name(F.col("name"))).filter("name IS NOT NULL AND trim(facts) <> ''").filter(~X.identifier_like(F.col("name")))
        found = extraction.with_extracted(self.candidates(pages).withColumn("kind", F.lit("entity")), more, by)
        found = found.join(pages.select("source_id", F.col("shown").alias("label")).distinct(), "source_id").withColumn("type_key", extraction.of_kind(F.col("kind"))["type_key"])
        rows, notes = self._merged(found.withColumn("ord", F.col("ord").cast("long")).select("space_id", "type_key", "name", "ord", "label", "source_id", "facts"), dry_run)
        if dry_run:
            return rows.select("space_id", "id", "name", "type_key", "created")
        empty = F.array().cast(f"array<{S.PROPERTY}>")
        summary = answers.select(*by, F.substring(X.strip_controls(F.coalesce(F.col("answer")["summary"], F.lit(""))), 1, SUMMARY).alias("_s"))
        src = pages.join(summary, by, "left").select("space_id", F.col("source_id").alias("id"), F.substring("shown", 1, 200).alias("name"), F.lit("wiki_source").alias("type_key"), empty.alias("properties"), F.col("markdown").alias("_m"), "_s", "source")
        src = src.withColumn("properties", S.with_property("wiki_excerpt", "text", F.substring(X.scrub_text_urls(F.col("_m")), 1, EXCERPT))).withColumn("properties", S.with_property("wiki_url", "url", X.scrub_url_secrets(F.col("source"))))
        src = src.withColumn("properties", F.when(F.trim("_s") != "", S.with_property("wiki_summary", "text", F.col("_s"))).otherwise(F.col("properties"))).withColumn("properties", S.with_property("wiki_ingested_at", "date", F.lit(now)))
        document = F.struct(F.lit("document").alias("id"), F.lit("document").alias("name"))
        src = src.withColumn("properties", S.with_property("wiki_source_type", "select", document))
        src = src.select("space_id", "id", "name", "type_key", "properties", F.lit(None).cast("boolean").alias("created")).dropDuplicates(["space_id", "id"])
        done = self._put_made(rows.unionByName(src), now)
        notes = notes.unionByName(lost).unionByName(answers.filter("error IS NOT NULL").select(F.lit("extraction").alias("step"), F.col("error").alias("note")))
        degraded = self._degraded(notes)
        for r in done.groupBy("space_id").agg(F.count_if("created").alias("c"), F.count_if(~F.col("created")).alias("u")).collect():
            self._log(r["space_id"], "ingest", "sources", now, r["c"], r["u"], degraded)
        return done

    @staticmethod
    def _degraded(notes: DataFrame) -> str:
        """What was degraded, as `step: note (times)`, the ten most frequent."""
        most = notes.groupBy("step", "note").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step", "note").limit(10).collect()
        return "; ".join(f"{r['step']}: {r['note'][:100]} ({r['n']})" for r in most)

    def remember(self, space: str, work_id: str, subjects: list[str], order: int, knowledge: dict[str, str] | None = None, note: str | None = None, now: str | None = None) -> None:
        """Queues a batch of subjects by name, with what is known of each; drain applies it. With `now`, the note becomes their source object.

        The knowledge is written before the event that begins the work, so a begun subject always has it.
        """
        source = self.narrate(space, note, now).select("id").first()[0] if now else None
        label = note or "agent"
        rows = [(space, work_id, s, s, (knowledge or {}).get(s, ""), label, source) for s in dict.fromkeys(subjects)]
        self.store.upsert("subjects", self.spark.createDataFrame(rows, S.SUBJECTS), ["space_id", "work_id", "subject_id"])
        row = [(space, work_id, "begin", subjects, None, order)]
        self.store.append("queue", self.spark.createDataFrame(row, S.QUEUE))

    def apply_pending(self, left: DataFrame, now: str) -> DataFrame:
        """Writes pending subjects (space_id, work_id, subject_id, ord, pos) as objects: resolved by title, merged by source. (space_id, id, name, type_key, created).

        A subject whose name is unusable is passed over. Applying the same subjects again changes nothing, as facts that a
        source has told are skipped.
        """
        told = left.join(self.store.read("subjects"), ["space_id", "work_id", "subject_id"]).withColumn("name", X.sanitize_name(F.col("name")))
        # Works in order, and within a work its subjects: a source may speak of one subject in several works.
        turn = F.row_number().over(Window.partitionBy("space_id", X.normalize_title(F.col("name"))).orderBy("ord", "work_id", "pos"))
        told = told.filter("name IS NOT NULL").withColumn("source_id", F.coalesce("source_id", X.uuid5(F.concat_ws(":", "space_id", F.lit("narration"), "work_id"))))
        told = told.withColumn("ord", turn.cast("long"))
        rows, _ = self._merged(told.select("space_id", F.lit("wiki_entity").alias("type_key"), "name", "ord", "label", "source_id", "facts"))
        return self._put_made(rows, now)

    def drain(self, apply=None, now: str = "") -> int:
        """Applies the pending subjects, with apply(pending DataFrame) or as objects, and only then marks them done; with nothing left the queue is emptied.

        If it stops in between, the next drain applies the same subjects again.
        """
        events = self.store.read("queue")  # read as it was: what comes meanwhile is not marked
        left = worklog.pending(events)
        count = left.count()
        if count:
            if apply is None:
                self.apply_pending(left, now)
            else:
                apply(left)
            done = left.select("space_id", "work_id", F.lit("done").alias("kind"), F.lit(None).cast("array<string>").alias("subjects"), "subject_id", "ord")
            self.store.append("queue", done)
            for r in left.groupBy("space_id").agg(F.count("*").alias("n")).collect():  # a row a space
                self._log(r["space_id"], "remember", "drain", now, updated=r["n"])
        if worklog.pending(self.store.read("queue")).isEmpty():
            self.store.replace("queue", self.store.read("queue").limit(0))
        return count

    def reindex(self, force: DataFrame | None = None) -> dict[str, int]:
        """Chunks and embeds what changed, drops what vanished, and bumps the versions of the spaces concerned.

        Only the points of changed objects are written, as an addition; so are those of force (space_id, object_id), embedded anew though unchanged.
        """
        objects = self.store.read("objects").filter("NOT coalesce(archived, false)")
        current = objects.select("space_id", F.col("id").alias("object_id"), "last_modified")
        changes = incremental.snapshot_diff(self.store.read("state"), current)
        if force is not None:
            asked = force.select("space_id", "object_id", F.lit(True).alias("_asked")).distinct()
            changes = changes.join(asked, ["space_id", "object_id"], "left").withColumn("change", F.when(F.col("_asked") & (F.col("change") == "unchanged"), "changed").otherwise(F.col("change"))).drop("_asked")
        changes = changes.persist()
        todo = objects.join(changes.filter("change IN ('new', 'changed')").select("space_id", F.col("object_id").alias("id")), ["space_id", "id"], "left_semi")
        texts = todo.withColumn("properties", F.transform("properties", lambda p: F.struct(p["key"].alias("key"), p["text"].alias("text"))))
        parts = chunk.chunks(texts).join(todo.select("space_id", F.col("id").alias("object_id"), *S.payload()), ["space_id", "object_id"])
        fresh = self.embedder.embed(parts, "text")
        stats = {r["change"]: r["objects"] for r in incremental.reindex_stats(changes).collect()}
        if set(stats) - {"unchanged"}:
            self.store.append("points", incremental.point_additions(changes, fresh.select(*[f.split()[0] for f in S.POINTS.split(", ")])))
            self.store.replace("versions", incremental.bump(self.store.read("versions"), changes))
            self.store.replace("state", current.withColumn("last_modified", F.coalesce("last_modified", F.lit(incremental.UNKNOWN))))
        changes.unpersist()
        return stats

    def forget(self, objects: DataFrame) -> None:
        """Deletes the points of objects (space_id, object_id) and what is known of their state, so that a later reindex takes them as new."""
        gone = objects.select("space_id", "object_id").distinct().withColumn("change", F.lit("removed"))
        points = self.store.read("points")
        self.store.append("points", incremental.point_additions(gone, points.limit(0)))
        self.store.replace("versions", incremental.bump(self.store.read("versions"), gone))
        self.store.replace("state", self.store.read("state").join(gone, ["space_id", "object_id"], "left_anti"))

    def _index(self, space: str) -> search.Index:
        """The space's postings, made anew only if its version changed since they were written."""
        row = self.store.read("versions").filter(F.col("space_id") == space).first()
        version = row["version"] if row else 0
        told = self.store.read("corpus").filter((F.col("space_id") == space) & (F.col("version") == version)).first()
        if told is None:
            own = self._rows(space)
            here = (F.col("space_id") == space) & (F.col("version") == version)
            if self.store.read("terms").filter(here).isEmpty():  # else a search stopped between the two writes, and the postings are whole
                made = search.postings(own, "row", search.chunk_words()).withColumn("space_id", F.lit(space)).withColumn("version", F.lit(version).cast("long"))
                if not own.isEmpty():
                    self.store.append("terms", made.select(*self.store.read("terms").columns).sortWithinPartitions("term"))
            stats = search.corpus(self.store.read("terms").filter(here), ("space_id", "version"))
            none = self.spark.createDataFrame([(space, version, 0, 0.0, 0.0)], S.CORPUS)  # an empty space is known to be so
            self.store.append("corpus", none if stats.isEmpty() else stats)
            told = self.store.read("corpus").filter((F.col("space_id") == space) & (F.col("version") == version)).first()
        held = self.store.read("terms").filter((F.col("space_id") == space) & (F.col("version") == version))
        return search.Index(held.select("term", "row", "tf", "size"), told["n"] if told else 0, (told["avgdl"] if told else 0) or 1.0, (told["mean"] if told else 0) or 0.0)

    def tidy(self) -> None:
        """Leaves out postings of versions that are past."""
        now = self.store.read("versions").select("space_id", "version")
        self.store.replace("terms", self.store.read("terms").join(F.broadcast(now), ["space_id", "version"], "left_semi"))

    def _rows(self, space: str) -> DataFrame:
        own = self.store.read("points").filter(F.col("space_id") == space).drop("embedding")
        return own.withColumn("row", F.concat_ws(":", "object_id", F.lpad(F.col("chunk_idx").cast("string"), 6, "0")))

    def search(self, text: str, space: str | None = None, limit: int = 10, filters: search.Filters | None = None) -> DataFrame:
        """Hits, best first. Without a space only the nearest by meaning; without types asked, sources are left out."""
        filters = (filters or search.Filters()).checked()
        if not filters.types and not filters.source_type:
            filters = search.Filters(tuple(t for t in S.TYPES if t != "wiki_source"), (), filters.domain_tags, filters.after, filters.before)
        points = self.store.read("points")
        depth = max(2 * limit, 50)
        if space is None or limit <= 0:
            near = search.dense(points.filter(filters.column()), "embedding", self.embedder.vector(text), max(limit, 0), "point_id")
            return near.select(F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"), "object_id", "object_name", "type_key", "heading", F.substring("text", 1, search.HIT_CHARS).alias("text"), F.round("score", 4).alias("score"))
        own = points.filter(F.col("space_id") == space)
        near = search.dense(own.filter(filters.column()), "embedding", self.embedder.vector(text), depth, "point_id")
        near = near.select("point_id", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"))
        rows = self._rows(space)
        ranked = search.hybrid_rank(rows, text, near, limit, filters, index=self._index(space))
        return search.hits(ranked.drop("object_id"), rows.select("point_id", "object_id", "object_name", "type_key", "heading", "text")).orderBy("rank")

    def query(self, question: str, space: str, now: str, budget: int = 2000, file_back: bool | None = None) -> dict:
        """An answer from the best objects and their neighbours within the budget, filed if it rests on enough."""
        objects = self.store.read("objects").filter((F.col("space_id") == space) & ~F.coalesce(F.col("archived"), F.lit(False)))
        found = search.candidates(self.search(question, space), True)
        seeds = found.select(F.col("object_id").alias("id"), F.col("pos").alias("seed_rank"))
        adj = graph.adjacency(objects.select("id", S.outbound().alias("outbound"))).withColumnRenamed("pos", "priority")
        near = graph.expand(adj, seeds)
        picked = seeds.select("id", F.col("seed_rank").alias("pos")).unionByName(near.select("id", (F.lit(1000) + F.row_number().over(Window.orderBy("seed_rank", "priority", "id"))).alias("pos")))
        body = objects.select("id", "name", F.coalesce(F.nullif(S.knowledge(), F.lit("")), F.col("markdown")).alias("text"))
        body = body.withColumn("name", F.coalesce(X.sanitize_name(F.col("name")), F.lit("[REDACTED]"))).withColumn("text", F.substring("text", 1, graph.OBJECT_TOKENS * graph.CHARS_PER_TOKEN))
        kept = graph.context(picked.join(body, "id"), budget).orderBy("pos").collect()  # at most CONTEXT_OBJECTS rows
        answer = self.synthesizer.answer(question, [(r["name"], r["text"]) for r in kept])
        filed = None
        used = [r["id"] for r in kept if r["pos"] < 1000]
        if (file_back or (file_back is None and len(used) >= FILE_SOURCES and len(answer.split()) >= FILE_WORDS)) and answer:
            filed = self._file(space, question, answer, used, now)
        self._log(space, "query", question, now, created=int(filed is not None))
        return {"answer": answer, "objects": [r["id"] for r in kept], "filed": filed}

    def _file(self, space: str, question: str, answer: str, used: list[str], now: str) -> str:
        row = self.spark.createDataFrame([(space, question[:100], question[:200], answer, used)], "space_id string, name string, q string, a string, used array<string>")
        row = row.withColumn("id", X.uuid5(F.concat_ws(":", "space_id", F.lit("wiki_query"), "q"))).withColumn("properties", F.array().cast(f"array<{S.PROPERTY}>"))
        for key, field, value in (("wiki_question", "text", "q"), ("wiki_answer", "text", "a"), ("wiki_drew_from", "objects", "used")):
            row = row.withColumn("properties", S.with_property(key, field, F.col(value)))
        self.put(row.select("space_id", "id", "name", F.lit("wiki_query").alias("type_key"), "properties", F.lit("").alias("markdown"), F.lit(False).alias("archived"), F.lit(now).cast("timestamp").alias("created_date"), F.lit(now).alias("last_modified"), F.array().cast("array<string>").alias("backlinks")))
        return row.select("id").first()[0]

    def relate(self, space: str, edges: DataFrame) -> DataFrame:
        """Typed edges (from_id, label, to_id, source_id) merged into the links; gives what was done to each of them."""
        wanted = edges.withColumn("label", X.edge_label(F.col("label")))
        pair = ["from_id", "label", "to_id"]
        stored = self.store.read("links").filter(F.col("space_id") == space).join(wanted.select(*pair).distinct(), pair, "left_semi")
        merged = graph.merge_links(stored, wanted)
        rows = merged.select(F.lit(space).alias("space_id"), X.uuid5(F.concat_ws(":", F.lit(space), *pair)).alias("link_id"), *pair, "sources", "action")
        batch = f"{self.store.root}/edges/{uuid.uuid4().hex}"  # what is told must be what was written
        rows.write.parquet(batch)
        done = self.spark.read.parquet(batch)
        self.store.upsert("links", done.filter("action <> 'unchanged'"), ["space_id", "link_id"])
        return done.select(*pair, "action")

    def duplicates(self, space: str, adjudicate: bool = False, budget: int | None = None) -> DataFrame:
        """(a, b, reason, score, verdict, recommendation): entities and concepts that may be one, by their titles, else by the meaning of what they are described as.

        With adjudicate the `budget` likeliest pairs (all without one) are put to the judge; else all are unjudged.
        """
        known = self.store.read("objects").filter((F.col("space_id") == space) & F.col("type_key").isin(*S.RELATION_KEY) & ~F.coalesce("archived", F.lit(False)))
        own = self._kept(known.select("id", "name", S.knowledge().alias("facts"), F.coalesce(F.nullif(S.prop("wiki_description")["text"], F.lit("")), "name").alias("asked")))
        points = self.store.read("points").filter((F.col("space_id") == space) & F.col("type_key").isin(*S.RELATION_KEY)).select(F.col("object_id").alias("id"), "embedding")
        points = points.join(own.select("id"), "id", "left_semi")
        asked = self.embedder.embed(own.select("id", "asked"), "asked").select("id", "embedding")
        found = self._kept(duplicates.pairs(resolve.title_pairs(own.select("id", "name")), resolve.embedding_band(points, asked=asked, key="id")))
        return self._kept(duplicates.judged(found, own, self.judge, budget if adjudicate else 0))

    def lint(self, space: str, now: str, threshold: str = "all", duplicates: bool = False, adjudicate: bool = False, budget: int | None = None) -> DataFrame:
        """Findings on a space, of the threshold's severity or worse; with duplicates also pairs that may be one, judged if asked for."""
        o = self.store.read("objects").filter(F.col("space_id") == space)
        text = F.coalesce(S.prop("wiki_description")["text"], F.lit(""))
        objects = o.select(
            "id", "type_key", "name", F.col("created_date").alias("created"), F.try_to_timestamp("last_modified").alias("last_modified"), "archived", S.prop("wiki_status")["select"]["name"].alias("status"),
            F.try_to_timestamp(S.prop("wiki_last_reviewed")["date"]).alias("last_reviewed"), text.alias("description"), S.relation_ids("wiki_sources").alias("sources"), S.outbound().alias("outbound"),
            F.coalesce("backlinks", F.array().cast("array<string>")).alias("backlinks"), S.relation_ids("wiki_contradictions").alias("contradictions"),
        )
        failed = self.store.read("log").filter((F.col("space_id") == space) & F.col("notes").contains("relation_rollback")).select(F.col("at").alias("ts"))
        pairs = self.duplicates(space, adjudicate, budget).select("a", "b", F.coalesce("reason", F.concat(F.lit("score "), F.col("score").cast("string"))).alias("why"), "recommendation") if duplicates else None
        if pairs is not None:
            pairs = pairs.select("a", "b", F.concat_ws(": ", "why", "recommendation").alias("reason")) if adjudicate else pairs.select("a", "b", F.col("why").alias("reason"))
        stored = self.store.read("links").filter(F.col("space_id") == space)
        return graph.at_least(graph.lint(objects, stored, failed, now, pairs), threshold)

    def prune_citations(self, space: str, now: str) -> int:
        """Takes answers out of the relations of entities and concepts, and gives the number of objects changed."""
        objects = self.store.read("objects").filter(F.col("space_id") == space)
        answers = objects.filter("type_key = 'wiki_query'").select("id")
        known = objects.filter(F.col("type_key").isin(*S.RELATION_KEY)).withColumn("_listed", S.outbound())
        kept = planning.prune(known, answers, "_listed").filter(F.size("_listed") < F.size(S.outbound()))
        return self._relations(kept, "_listed", now)

    def _relations(self, objects: DataFrame, listed: str, now: str) -> int:
        """Writes objects with the relations that the column lists; the number of them."""
        for kind, key in S.RELATION_KEY.items():
            objects = objects.withColumn("properties", F.when(F.col("type_key") == kind, S.with_property(key, "objects", F.col(listed))).otherwise(F.col("properties")))
        rows = self._kept(objects.drop(listed).withColumn("last_modified", F.lit(now)))
        count = rows.count()
        if count:
            self.put(rows)
        return count

    def _repair(self, space: str, confirmed: list[str]) -> tuple[DataFrame, DataFrame, dict]:
        """The space's untagged records, what a repair would clear (object_id, clear, keep), and its kind, evidence and digest."""
        objects = self.store.read("objects").filter(F.col("space_id") == space)
        logs = self.store.read("log").filter(F.col("space_id") == space)
        logs = logs.select("space_id", F.concat_ws(":", "at", "subject").alias("id"), F.concat_ws(" ", "action", "subject").alias("name"), F.lit("log").alias("what"), F.col("action").alias("tag"))
        told = objects.filter("type_key = 'wiki_source'").select("space_id", "id", "name", F.lit("source").alias("what"), S.prop("wiki_source_type")["select"]["name"].alias("tag"))
        records = self._kept(logs.unionByName(told))
        named = self.spark.createDataFrame([(space, i) for i in confirmed], "space_id string, id string")
        kinds = repair.classified(records, named).select("space_id", "kind", "actions", "source_types")
        known = objects.filter(F.col("type_key").isin(*S.RELATION_KEY)).select("space_id", "id", S.outbound().alias("outbound"))
        pair = [F.least("from_id", "to_id").alias("x"), F.greatest("from_id", "to_id").alias("y")]
        linked = self.store.read("links").filter(F.col("space_id") == space).select("space_id", *pair)
        plan = self._kept(repair.items(known, linked.unionByName(links.pairs(objects).select(F.lit(space).alias("space_id"), "x", "y"))))
        seen = kinds.first()
        kind = seen["kind"] if seen else repair.UNKNOWN
        row = repair.digest(self.spark.createDataFrame([(space, kind)], "space_id string, kind string"), plan, named).first()
        report = {"space_id": space, "kind": kind, "evidence": {"actions": dict(seen["actions"]) if seen else {}, "source_types": dict(seen["source_types"]) if seen else {}}, "ids_to_clear": row["cleared"], "digest": row["digest"]}
        return repair.untagged(records), plan, report

    def plan_repair(self, space: str, confirmed: list[str] = ()) -> tuple[DataFrame, dict]:
        """(rows, report): the related ids (object_id, clear, keep) that no link stands behind, and the space's kind, evidence and digest. Reads only."""
        _, plan, report = self._repair(space, list(confirmed))
        return plan.drop("space_id"), report

    def apply_repair(self, space: str, expect: str, path: str, now: str, confirmed: list[str] = ()) -> dict:
        """Clears what plan_repair told, under the space's lock, after what the objects listed is written to a new place.

        Refused, with nothing written, for a space that not ingests alone wrote, where the confirmed ids aren't exactly the
        untagged ones, where the digest isn't that of the plan as it is now, and where the backup's place is taken.
        """
        with runtime.lock(self.spark, self.store.root, f"space-{space}"):
            bare, plan, report = self._repair(space, list(confirmed))
            named = self.spark.createDataFrame([(i,) for i in dict.fromkeys(confirmed)], "id string")
            bare = bare.select("id").distinct()
            exact = bare.join(named, "id", "left_anti").isEmpty() and named.join(bare, "id", "left_anti").isEmpty()
            kind, live = report["kind"], report["digest"]
            if kind == repair.MIXED or (exact and kind != repair.INGEST_ONLY):
                raise repair.Refused("kind", f"the space is {kind}, not {repair.INGEST_ONLY}", live)
            if not exact:
                raise repair.Refused("confirm_list", "the confirmed ids must be the untagged ids of the space", live)
            if live != expect:
                raise repair.Refused("digest_mismatch", "the plan is not the one that was expected", live)
            fs, p = self.store._fs(path)
            if fs.exists(p):
                raise repair.Refused("backup_exists", f"there is something at {path}", live)
            held = self.store.read("objects").filter(F.col("space_id") == space).join(plan.select("space_id", F.col("object_id").alias("id"), "keep"), ["space_id", "id"])
            backup(held.select("space_id", F.col("id").alias("object_id"), "type_key", S.outbound().alias("prior_ids"), F.lit(live).alias("digest")), path)
            changed = self._relations(held, "keep", now)
            return {"space_id": space, "kind": kind, "digest": live, "backup": path, "objects_modified": changed, "ids_cleared": report["ids_to_clear"]}
