"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Spans are found by pattern; the hashes of their values are aggregated by distinct repositories and
owners over the whole corpus. A value that several owners hold, or two in several repositories, is a widely copied example; one that stays with few
looks live. The method adds spans: long mixed tokens that no base pattern
names, where their value stays with few owners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import RowStore, fresh, materialise

#: kind, pattern, group that holds the value, its least length; in the order of ties.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own kind: tokens of 32 or more with upper case, lower case and digits.
MIXED = ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}", 0, 32)
#: A value with at least so many owners is a widely copied example.
EXAMPLE_OWNERS = 3
#: So is one with two owners in at least so many repositories; many repositories of one owner share what is that owner's.
EXAMPLE_REPOS = 4
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"
#: Matches that are folded into one list; lists are put together afterwards, so that the work grows with the matches and not with their square.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column) -> Column:
    """An array that isn't empty, in pieces of BLOCK."""
    return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches with a long enough value, with code point positions.

    The pieces between the matches and the matches themselves alternate, so positions are running sums of their lengths.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda m: F.regexp_extract(m, f"^{pattern}$", group)) if group else (lambda m: m)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["match"])
        v = value(x["match"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(v, 256).alias("hash"))
        out = F.when(F.char_length(v) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def folded(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)

    def shifted(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["hash"].alias("hash")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    both = let(found, lambda f: F.zip_with(F.slice(pieces, 1, F.size(f)), f, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))))
    each = let(both, lambda items: F.transform(blocks(items), folded))
    placed = F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), shifted, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def found_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(spans_of(text, *k, i) for i, k in enumerate((*KINDS, MIXED)))))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_found of candidate rows (hash, owner, repo): each step aggregates before it shuffles."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def judged(rows: DataFrame) -> DataFrame:
    """rid and its spans with ``live``, of the rows (rid, owner, repo, spans) that have spans."""
    found = rows.where(F.size("spans") > 0).select("rid", "owner", "repo", F.explode("spans").alias("s")).select("rid", "owner", "repo", "s", F.col("s.hash").alias("hash"))
    frequency = ownership(found)
    joined = found.join(frequency, "hash").withColumn("live", (F.col("n_owners") < EXAMPLE_OWNERS) & ((F.col("n_owners") < 2) | (F.col("n_repos") < EXAMPLE_REPOS)))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), "live", "n_owners", "n_repos", "n_found")
    return joined.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("judged"))


def candidates(df: DataFrame, rid: Column, text: str, key: str, owner: str, repo: tuple[str, ...]) -> DataFrame:
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    return df.select(rid.alias("rid"), df[key].alias("doc_id"), empty(owner).alias("owner"), F.sha2(F.concat_ws("\x00", *map(empty, repo)), 256).alias("repo"), found_spans(df[text]).alias("spans"))


def line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each row of ``df``: counts of base spans, their digest, all spans, and how many look live or copied.

    A null text is empty and has no spans; a null owner or repository counts as one called ''. Rows with equal keys are judged each on its
    own. An empty table gives no rows; other columns are not read. Positions are code points, ends exclusive. A very long text is scanned whole; matches are folded
    in blocks, so the work grows with their number.
    """
    rows = materialise(candidates(df, F.monotonically_increasing_id(), text, key, owner, repo), "secrets")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    all_judged = F.coalesce("judged", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,live:boolean,n_owners:bigint,n_repos:bigint,n_found:bigint>>"))
    shown = F.filter(all_judged, lambda s: (s["rank"] < len(KINDS)) | s["live"])
    return rows.join(judged(rows), "rid", "left").select(
        "doc_id", *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)), F.sha2(line(base), 256).alias("base_sha256"), line(shown).alias("spans"),
        F.size(F.filter(all_judged, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(all_judged, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]") -> DataFrame:
    """``df`` with live-looking spans replaced by ``mark``; widely copied examples stay. Only rows with spans are joined.

    Spans that overlap are replaced by one mark. A null text stays null; repeated rows are each marked; an empty table gives no rows; all other columns stay as they are, whatever
    their names.
    """
    store = RowStore.write(df, "redact")
    rid, columns = store.rid, df.columns
    rows = materialise(candidates(store.df, F.col(rid), text, key, owner, repo).where(F.size("spans") > 0), "secrets")
    live = judged(rows).select("rid", F.filter("judged", lambda s: s["live"]).alias("judged")).where(F.size("judged") > 0)
    spans, whole = fresh(store.df, "judged"), F.col(text)
    marked = store.df.join(live.select(F.col("rid").alias(rid), F.col("judged").alias(spans)), rid, "left")

    def block_marked(acc: Column, block: Column) -> Column:
        stop = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"])))

        def pieces(here: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                piece = F.concat(F.substring(here, a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit(mark))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

            return F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.array_join(a["out"], ""))

        made = let(F.substring(whole, acc["at"] + 1, stop - acc["at"]), pieces)
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(blocks(F.col(spans)), start, block_marked, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.char_length(whole))))
    return marked.select(*((F.when(F.size(F.coalesce(spans, F.array().cast(live.schema["judged"].dataType))) > 0, folded).otherwise(whole) if c == text else F.col(c)).alias(c) for c in columns))
