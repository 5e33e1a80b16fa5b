"""The engine's front: ingest a statement, keep its layers, answer questions by queries."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.functions.sql import rules_of
from monthwise.operators import base, facts, months, payees, postings, relational, search, vectors
from monthwise.plans import answers
from monthwise.plans.intent import Intent, classify
from monthwise.plans.versions import Conflict, Version, Versions
from monthwise.sources import statements

_NAMED = "array<struct<name:string,amount:double>>"
_LARGEST = "struct<amount:double,payee:string,date:string>"
#: What is kept by month.
BY_MONTH = {
    "transactions": "id long, account long, date string, ym string, description string, payee string, category string, amount decimal(18,2), balance decimal(18,2), is_upi int",
    "months": f"ym string, income double, spending double, net double, count long, upi long, categories map<string,double>, payees array<struct<name:string,vol:double>>, largest {_LARGEST}",
    "base": base.SCHEMA,
    "chunks": "id long, ym string, content string, contextual string, embedding array<double>, contextual_embedding array<double>",
    "postings": "token string, id long, ym string, length long, tf long",
    "text_stats": "ym string, texts long, tokens long",
    "payee_pairs": "pair string, entry string, payee string, ym string",
}
#: How a layer's rows are dealt to folders; ``month`` is the key of versions in all of them.
FOLDERS = {"postings": ["bucket"], "payee_pairs": ["bucket"]}
#: What is kept for all months together.
WHOLE = {
    "periods": f"id string, anchor string, window int, label string, start string, months array<string>, income double, expense double, net double, count long, top_categories {_NAMED}, top_payees {_NAMED}, largest {_LARGEST}, content string, embedding array<double>",
    "meta": "key string, value string",
    "rejects": statements.REJECTS,
}
COLUMNS = [x.split()[0] for x in BY_MONTH["transactions"].split(", ")]
CHUNK_COLUMNS = ["date", "description", "category", "amount", "balance"]
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "AED": "AED "}
NOT_FOUND = "Not found in this statement."
NOT_UNDERSTOOD = "This cannot be answered: the question has a condition that is not understood."
#: What stands before a chunk in its contextual form; a change is tried so often against other writers.
CONTEXT, MOST_ATTEMPTS = "Bank statement", 5
#: A statement whose chunks have no more characters is given whole as context.
WHOLE_CONTEXT, CONTEXT_ROWS = 18_000, 30


def markdown(rows: list[dict], title: str = "") -> str:
    """A table of a small result."""
    if not rows:
        return NOT_FOUND
    names = list(rows[0])
    table = [f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *(f"| {' | '.join('' if r[n] is None else str(r[n]) for n in names)} |" for r in rows)]
    return "\n".join([*([f"**{title}**", ""] if title else []), *table])


class Engine:
    """Layers of a statement under one folder; nothing is kept in the driver.

    A change writes what is new to a folder of its own, all layers of it, and then makes
    the next version, which names the folder of each of its months. So a change is seen
    whole or not at all, what is read while it is made stays as it was, and a month
    without rows is gone. Writers don't wait for each other: one that finds its number
    taken puts its months into the version that came before it, and is refused
    (``Conflict``) if that one changed the same months.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: search.Embedder | None = None):
        self.spark, self.folder, self.embedder = spark, folder.rstrip("/"), embedder or search.HashingEmbedder()
        self.versions = Versions(spark, self.folder)

    def _layer(self, name: str, version: Version | None = None, only: list[str] | None = None) -> DataFrame:
        """A layer of the months of a version (the last one), or of some of them; files of other months are not read."""
        schema, parts, version = BY_MONTH[name], [], version or self.versions.last()
        more = "".join(f", {c} int" for c in FOLDERS.get(name, ()))
        for folder in sorted(set(version.months.values())):
            own = [ym for ym, f in version.months.items() if f == folder and (only is None or ym in only)]
            if own:
                parts.append(self.spark.read.schema(f"{schema}, month string{more}").parquet(f"{folder}/{name}").where(F.coalesce("month", F.lit("")).isin(*own)).drop("month"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + more)

    def _whole(self, name: str, version: Version | None = None) -> DataFrame:
        folder = (version or self.versions.last()).whole
        return self.spark.createDataFrame([], WHOLE[name]) if folder is None else self.spark.read.schema(WHOLE[name]).parquet(f"{folder}/{name}")

    def _write_months(self, t: DataFrame, folder: str) -> set[str]:
        """Write the layers by month of transactions; the months they have."""

        def write(name: str, df: DataFrame) -> DataFrame:
            df, keys = df.withColumn("month", F.col("ym")), FOLDERS.get(name, ["month"])
            # A month's rows meet in tasks of a fair size: a small month is one file, a large one several.
            df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{folder}/{name}")
            return self.spark.read.schema(f"{BY_MONTH[name]}, month string" + "".join(f", {c} int" for c in FOLDERS.get(name, ()))).parquet(f"{folder}/{name}")

        stored = write("transactions", t.select(*COLUMNS)).drop("month")
        sums = write("base", base.base(stored)).drop("month")
        write("months", base.month_gold(sums, months.PAYEES_A_MONTH))
        chunks = stored.select("id", "ym", scalars.chunk_text(F.col("id"), CHUNK_COLUMNS).alias("content"))
        chunks = chunks.withColumn("contextual", scalars.contextual_chunk(F.col("content"), CONTEXT))
        chunks = self.embedder.embed(chunks, "content").withColumnRenamed("embedding", "raw")
        chunks = self.embedder.embed(chunks, "contextual").withColumnsRenamed({"embedding": "contextual_embedding", "raw": "embedding"})
        texts = write("chunks", chunks).select("id", "ym", "content")
        write("postings", postings.postings(texts).withColumn("bucket", postings.bucket(F.col("token"))))
        write("text_stats", postings.text_stats(texts, "ym"))
        pairs = payees.dictionary(sums.select("payee", "ym").distinct())
        write("payee_pairs", pairs.withColumn("bucket", payees.bucket(F.col("pair"))))
        return {r["ym"] for r in sums.select(F.coalesce("ym", F.lit("")).alias("ym")).distinct().collect()}

    def _write_whole(self, version: Version, meta: dict[str, str], rejects: DataFrame) -> None:
        """Write the layers of all months of a version that is being made."""
        spans = months.period_gold(self._layer("months", version))
        text = scalars.metrics_text(*(F.col(c) for c in ("label", "income", "expense", "net", "count", "top_categories", "top_payees")), SYMBOLS[meta.get("currency", "INR")])
        self.embedder.embed(spans.withColumn("content", text), "content").select(*self._names("periods")).write.parquet(f"{version.whole}/periods")
        rejects.select("path", "line", "reason").write.parquet(f"{version.whole}/rejects")
        self.spark.createDataFrame(sorted(meta.items()), WHOLE["meta"]).write.parquet(f"{version.whole}/meta")

    def _change(self, t: DataFrame, gone: set[str] | None = None, meta: dict[str, str] | None = None, rejects: DataFrame | None = None, since: Version | None = None) -> None:
        """Make a version in which the months ``gone`` (all if None) are replaced by what ``t`` has, which was read of ``since`` (the last version).

        ``rejects`` stay as they are if there are no others. Months that other writers change meanwhile are kept, unless they are among these.
        """
        since = since or self.versions.last()
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        found, meta = self._write_months(t, folder), dict(meta or {})
        if rejects is not None:
            counts = rejects.groupBy("reason").count().collect()  # a row a reason
            meta["rejected"] = ", ".join(sorted(f"{r['reason']}: {r['count']}" for r in counts))
        for attempt in range(MOST_ATTEMPTS):
            last = self.versions.last()
            others = last.changed(since)
            if others and (gone is None or others & (gone | found)):
                raise Conflict(f"another writer has changed {', '.join(sorted(others)[:5])}")
            state = {ym: f for ym, f in last.months.items() if gone is not None and ym not in gone} | dict.fromkeys(found, folder)
            version = Version(last.number + 1, state, f"{folder}/whole-{attempt}")
            self._write_whole(version, self._meta(last) | meta, self._whole("rejects", last) if rejects is None else rejects)
            if self.versions.publish(version):
                return
        raise Conflict("other writers were faster each time")

    def _meta(self, version: Version) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self._whole("meta", version).collect()}

    @staticmethod
    def _names(layer: str) -> list[str]:
        from pyspark.sql.types import StructType

        return StructType.fromDDL(WHOLE[layer]).names

    def rules(self) -> list[tuple[str, str]]:
        """(pattern, category) of the rules by which records without a category get one: those of ``meta``, or the usual ones."""
        kept = self.meta().get("rules")
        return [tuple(x) for x in json.loads(kept)] if kept else list(scalars.CATEGORY_RULES)

    def ingest(self, source: str | DataFrame, rules: DataFrame | None = None, **options) -> None:
        """Replace all layers by a file's, by positioned items of printed pages (doc, page, x, y, str), or by canonical records. The currency is read off a file's headers and cells; lines that are no records or no transactions are kept in ``rejects``. ``rules`` (place, pattern, category) are kept for the next files too."""
        own = self.rules() if rules is None else rules_of(rules)
        scanned = statements.scan(self.spark, source, **options) if isinstance(source, str) else statements.scan_items(source) if {"page", "x", "y", "str"} <= set(source.columns) else None
        raw = source if scanned is None else scanned.records
        records = raw if scanned is None else statements.normalise(raw)
        lost = statements.untyped(records) if scanned is None else scanned.rejects.unionByName(statements.untyped(records))
        found = relational.detect_currency(raw, raw.columns, "").first()["code"]
        meta = {"columns": ", ".join(raw.columns)} | ({"currency": found} if found else {}) | ({} if rules is None else {"rules": json.dumps(own)})
        self._change(statements.to_transactions(records, rules=own), meta=meta, rejects=lost)

    def transactions(self) -> DataFrame:
        return self._layer("transactions")

    def base(self) -> DataFrame:
        """The mergeable sums from which summaries are answered."""
        return self._layer("base")

    def months(self) -> DataFrame:
        """Month summaries with their categories, payees and largest transaction."""
        return self._layer("months")

    def chunks(self) -> DataFrame:
        """Search texts of all transactions, as they are and in their context, with their vectors."""
        return self._layer("chunks")

    def periods(self) -> DataFrame:
        return self._whole("periods")

    def rejects(self) -> DataFrame:
        """path, line, reason of what the last ingest did not take; their counts are in ``meta``."""
        return self._whole("rejects")

    def meta(self) -> dict[str, str]:
        return self._meta(self.versions.last())

    def currency(self) -> str:
        return self.meta().get("currency", "INR")

    def set_currency(self, code: str) -> None:
        """Show amounts in a currency from now on; amounts themselves don't change."""
        if code not in SYMBOLS:
            raise ValueError(f"{code!r} is no known currency")
        self._change(self.spark.createDataFrame([], BY_MONTH["transactions"]), set(), {"currency": code})

    def update_month(self, ym: str, new: DataFrame) -> None:
        """Replace one month, or delete it if there are no rows; rows of another month are an error and change nothing."""
        since = self.versions.last()
        if not new.where(F.col("ym").isNull() | (F.col("ym") != ym)).isEmpty():
            raise ValueError(f"rows outside {ym}")
        self._change(new, {ym}, since=since)

    def apply(self, rows: DataFrame, stream: str, number: int) -> bool:
        """Take a batch of a stream of transactions; False if the stream's version says that it was taken before.

        A transaction whose id is known replaces the one that is stored, in whatever month that is.
        Of several rows with one id in a batch the one with the latest date counts, then the greatest values.
        """
        for _ in range(MOST_ATTEMPTS):
            since = self.versions.last()
            key = f"stream {stream}"
            if int(self._meta(since).get(key, -1)) >= number:
                return False
            new = rows.groupBy("id").agg(F.max(F.struct("date", *(c for c in COLUMNS if c not in ("id", "date")))).alias("r")).select("id", "r.*").select(*COLUMNS)
            stored, ids = self._layer("transactions", since), new.select("id")
            old = stored.select("id", "ym").join(ids, "id", "left_semi").select("ym")
            touched = {r["ym"] for r in old.unionByName(new.select("ym")).distinct().collect()}  # months
            kept = self._layer("transactions", since, sorted(touched)).join(ids, "id", "left_anti")
            try:
                self._change(kept.unionByName(new), touched, {key: str(number)}, since=since)
                return True
            except Conflict:
                continue
        raise Conflict("other writers were faster each time")

    def rebuild(self) -> None:
        """Recompute all layers from the transactions, into one folder."""
        since = self.versions.last()
        self._change(self._layer("transactions", since), since=since)

    def clean_up(self, keep: int = 2, older_than: float = 24 * 3600) -> list[str]:
        """Delete what the last ``keep`` versions do not need and is older than some seconds."""
        return self.versions.remove_unreachable(keep, older_than)

    def reset(self) -> None:
        """Empty every layer."""
        self._change(self.spark.createDataFrame([], BY_MONTH["transactions"]))

    def state(self) -> dict:
        version = self.versions.last()
        return base.overview(self._layer("base", version)).first().asDict() | {"version": version.number, "months": len(version.months), "periods": self._whole("periods", version).count(), "currency": self._meta(version).get("currency", "INR")}

    def has_month(self, ym: str) -> bool:
        """Is there a transaction of this month? The version says so."""
        return ym in self.versions.last().months

    def month_count(self, ym: str) -> int:
        """How many transactions a month has, from its own row."""
        return self._layer("months", only=[ym]).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def is_empty(self) -> bool:
        return not self.versions.last().months

    def _latest(self, n: int) -> DataFrame:
        """The transactions of the last months that have n rows together."""
        version, wanted, rows = self.versions.last(), [], 0
        for r in self._layer("months", version).select("ym", "count").orderBy(F.desc("ym")).collect():  # a row a month
            if rows < n:
                wanted.append(r["ym"])
                rows += r["count"]
        return self._layer("transactions", version, wanted)

    def page(self, offset: int = 0, limit: int = 50, q: str | None = None) -> tuple[int, list[dict]]:
        t = self.transactions()
        return relational.page_total(t, q).first()[0], [r.asDict() for r in relational.page(t, offset, limit, q).collect()]

    def dashboard(self) -> dict[str, list[dict]]:
        """The parts of an overview page, each a few rows: sums come from the base rows, and transactions are read of the last months alone."""
        b, m = self.base(), self.months()
        parts = {
            "overview": base.overview(b),
            "categories": base.spending(b, "category", 8),
            "months": m.orderBy(F.desc("ym")).limit(12).select("ym", "income", "spending", "net", "count").orderBy("ym"),
            "payees": base.spending(b, "payee", 6),
            "subscriptions": base.subscriptions(b),
            "subscriptions_total": base.subscriptions_total(b),
            "recent": relational.recent(self._latest(12)),
            "balance": base.current_balance(b),
        }
        return {name: [r.asDict() for r in df.collect()] for name, df in parts.items()}

    def facts(self) -> str:
        return facts.facts_report(self.transactions())

    def keyword_search(self, question: str, n: int = 12) -> DataFrame:
        """id, score of the chunks that suit a question's words best; only the folders of its words' postings are read."""
        version = self.versions.last()
        return postings.search(self._layer("postings", version), self._layer("text_stats", version), question, n)

    def _vector_index(self, version: Version) -> vectors.VectorIndex:
        return vectors.VectorIndex(self.spark, f"{self.folder}/vectors/{version.number}")

    def index_vectors(self, lists: int = 64) -> None:
        """Make an index of the chunks' vectors for the last version; a later version is searched without one until it is made anew."""
        version = self.versions.last()
        self._vector_index(version).build(self._embedded(version), lists)

    def _embedded(self, version: Version) -> DataFrame:
        """The vectors of chunks in context, or their own where they have none."""
        return self._layer("chunks", version).select("id", F.coalesce("contextual_embedding", "embedding").alias("embedding"))

    def semantic_search(self, question: str, n: int = 12, probes: int | None = 16) -> DataFrame:
        """id, score of the nearest chunks: in ``probes`` lists of the version's index, or of all chunks if it has none."""
        vector = self.embedder.embed(self.spark.createDataFrame([(question,)], "content string"), "content").first()["embedding"]
        version = self.versions.last()
        index = self._vector_index(version)
        return index.search(vector, n, probes) if index.versions.numbers() else search.cosine_topk(self._embedded(version), vector, n)

    def search_rejects(self, question: str, n: int = 12) -> DataFrame:
        """line, score of the rejected lines that suit a question best: pages of an unknown layout can still be searched."""
        lines = self.rejects().select(F.xxhash64("path", "line").alias("id"), "line").dropDuplicates(["id"])
        return F.broadcast(search.bm25(lines, question, n, content="line")).join(lines, "id").select("line", "score").orderBy(F.desc("score"), "line")

    def search(self, question: str, n: int = 12) -> DataFrame:
        """The transactions that suit a question best, by words and by vectors, fused by rank and labelled."""
        found = search.fuse(self.semantic_search(question, n), self.keyword_search(question, n), n)
        return search.labelled(found, self.transactions())

    def context(self, question: str) -> tuple[str, str]:
        """What a question is answered from: all chunks of a small statement, the facts for a sum, else the best rows."""
        chunks = self.chunks()
        if (chunks.agg(F.sum(F.length("content"))).first()[0] or 0) <= WHOLE_CONTEXT:
            return "rows", "\n".join(r["content"] for r in chunks.select("content").orderBy("id").collect())  # WHOLE_CONTEXT characters
        if classify(question).kind not in ("search", "keyword"):
            return "facts", self.facts()
        return "search", markdown([r.asDict() for r in self.search(question, CONTEXT_ROWS).collect()])

    def payees_like(self, names) -> DataFrame:
        """name, payee, way, distance: the statement's payees that names mean; only the folders of the names' letter pairs are read."""
        return payees.like(self._layer("payee_pairs").drop("ym"), names)

    def answer(self, intent: Intent, similar: bool = False) -> DataFrame:
        """The query of an intent over the rows that its filters leave; with ``similar`` names are looked up in the dictionary of payees."""
        version = self.versions.last()
        only = answers.months_meant(intent, sorted(m for m in version.months if m))
        layers = answers.Layers(self._layer("transactions", version, only), self._layer("base", version, only), self._layer("months", version, only), self._whole("periods", version))
        if intent.kind == "search":
            return self.search(" ".join(intent.keywords))
        return answers.answer(intent, layers, self.payees_like(intent.keywords) if similar else None)

    def ask(self, question: str) -> tuple[Intent, DataFrame, str]:
        """Intent, query and a table of its rows; what the statement does not have is not found, and what is not understood is refused."""
        intent = classify(question)
        df = self.answer(intent)
        if intent.kind == "unknown":
            return intent, df, NOT_UNDERSTOOD
        rows = df.collect()
        if intent.keywords and intent.kind != "search" and (not rows or all(r["count"] == 0 for r in rows if "count" in r)):
            df = self.answer(intent, similar=True)
            rows = df.collect()
        if intent.keywords and all("count" in r and r["count"] == 0 for r in rows):
            rows = []
        return intent, df, markdown([r.asDict() for r in rows], intent.kind.replace("_", " ").capitalize())
