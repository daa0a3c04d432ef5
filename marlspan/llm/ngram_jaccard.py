"""N-gram Jaccard join with a token-group matrix.

A document's set are the 64-bit hashes of its distinct word n-grams. Documents
with equal sets form a class, and only the first of a class takes part below.

1. *Shared tokens.* Tokens are in one global order, rare ones first. Let
   ``need(size)`` be a tenth of a set's size. Two sets with Jaccard similarity
   ``t`` or more share at least ``need`` of the smaller one's size among the
   first ``size - ceil(t * size) + need(size)`` tokens of each: otherwise too few
   are left for the overlap. So only those prefixes take part. They are dealt in
   batches; a batch asks the partition of each token's hash whether another
   class has the token, at one row per batch however frequent it is, and only
   shared tokens become rows. The order may be any, so it is free to put
   frequent tokens last: each slice of texts reports the tokens that many of its
   documents have, and the ``HOT_TOKENS`` most frequent of those (a fixed bound
   on what is broadcast) rank behind all others.
2. *Groups.* The leader of a token list is its best supported class, the one
   whose tokens are in the longest lists for its size. Each class follows the
   leader it shares most tokens with, and is compared with it; leaders follow
   leaders, and all that end at the same class are a group of similar documents.
   A class that is left alone so joins the largest group that enough of its
   tokens are in.
3. *Token-group matrix.* The matrix holds a row per group and prefix token of
   the group's token union. A class meets another group of its size only if
   ``need`` of its prefix tokens are in the union, which bounds what it shares
   with every member, and only the groups that pass are opened. Of two groups,
   the smaller one's classes ask the larger one; a class that isn't in the
   component of its group's head asks its own group. Opened groups are compared
   exactly, in tiles of members and asking classes, and a tile tells links
   between different components only, one for each class and component.

Links inside a component change nothing, and every other link is between a
class and a group that it asks, so the components are exact.

Defined results: null text and text without a word has an empty set and links
with nothing; fewer than ``n`` words make one n-gram; null or repeated ids are
rows of their own, and a null id never names a component while another id is
there; other columns are ignored by :func:`near_components` and carried by
:func:`drop_near_copies`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    HOT_GROUPS, LEAST_HOT, connected_components, discard, durable, free_name, join_facts, let_go, numbered, objects, shuffle_width, slices, with_group_facts,
)
from .word_hash import token_sets

HOT_TOKENS = 1 << 18
#: Texts are worked on so many at a time; such a slice reports the tokens that HOT_IN_SLICE of its documents have.
SLICE_ROWS = 2000
HOT_IN_SLICE = 4
#: One in so many of a set's tokens must be shared among the prefixes.
NEED = 10
#: Prefix tokens in a batch, and in a partition of all of them.
BATCH_TOKENS = 1_000_000
#: Members, and asking classes, in a tile of an opened group.
TILE = 256
#: Rows of tiles that a call compares, about.
CALL_ROWS = 4096
#: Bits of the filter by which texts that need no second look are passed over.
FILTER_BITS = 1 << 24


def digest_of(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _first_pass(n: int):
    """Frequent tokens of each slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go("ngram_jaccard")
        for b in slices(batches, SLICE_ROWS):
            sets = list(token_sets(b["text"], n))
            tokens, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.int64),) * 2
            often = times >= HOT_IN_SLICE
            yield pd.DataFrame({"token": tokens[often], "n": times[often].astype("int64")})

    return run


def hot_tokens(texts: DataFrame, n: int) -> pd.DataFrame:
    """At most ``HOT_TOKENS`` tokens, sorted, with the rank of each: how often
    its slices reported it, in powers of two."""
    found = texts.mapInPandas(_first_pass(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toPandas().sort_values("token")
    return pd.DataFrame({"token": top["token"].to_numpy("int64"), "rank": np.log2(top["n"].to_numpy("float64")).astype("uint8") + 1})


def _prefixes(n: int, percent: int, hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go("ngram_jaccard")
        often, rank = hot.value
        told: set[bytes] = set()
        for b in slices(batches, SLICE_ROWS):
            sizes, digests, prefixes = [], [], []
            for tokens in token_sets(b["text"], n):
                size = len(tokens)
                d = digest_of(tokens)
                sizes.append(size)
                digests.append(d)
                if d is None or d in told:  # a partition tells the prefix of a class once
                    prefixes.append(None)
                    continue
                told.add(d)
                keep = size - -(-percent * size // 100) + -(-size // NEED)
                if len(often) and size:
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    level = np.where(often[at] == tokens, rank[at], 0)
                    tokens = tokens[np.argsort(level, kind="stable")]
                prefixes.append(tokens[:keep])
            yield pd.DataFrame({"row": b["row"], "id": b["id"].astype("Int64"), "size": sizes, "digest": objects(digests), "prefix": objects(prefixes)})

    return run


def _sets(n: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go("ngram_jaccard")
        bits = wanted.value
        for b in slices(batches, SLICE_ROWS):
            digests, sets = [], []
            for tokens in token_sets(b["text"], n):
                d = digest_of(tokens)
                if d is not None:
                    at = int.from_bytes(d[:3], "big")
                    if bits[at >> 3] >> (at & 7) & 1:
                        digests.append(d)
                        sets.append(tokens)
            yield pd.DataFrame({"digest": objects(digests), "tokens": objects(sets)})

    return run


def _need(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / NEED))


def _classes_of(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows, sizes and prefixes of the classes of a batch, the first row of each."""
    g = g.sort_values("row").drop_duplicates("digest")
    return g["row"].to_numpy(), g["size"].to_numpy(), g["prefix"].tolist()


def _ask_shared(n_parts: int):
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        let_go("ngram_jaccard")
        tokens, times = np.unique(np.concatenate(_classes_of(g)[2]), return_counts=True)
        at = np.r_[np.searchsorted(tokens, _edges(n_parts)), len(tokens)]
        out = [(k, int(key[0]), tokens[i:j].tobytes(), *_packed(times[i:j])) for k, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return pd.DataFrame(out, columns=["part", "batch", "tokens", "twice", "times"])

    return run


def _packed(times: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of mostly ones: a bit for each that is more, and those."""
    twice = times > 1
    return np.packbits(twice).tobytes(), times[twice].astype("<u4").tobytes()


def _unpacked(twice: bytes, times: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[np.unpackbits(np.frombuffer(twice, "u1"), count=n).astype(bool)] = np.frombuffer(times, "<u4")
    return out


def _edges(n_parts: int) -> np.ndarray:
    return np.array([-(2**63) + 2**64 * k // n_parts for k in range(n_parts)], np.int64)


def _answer_shared(g: pd.DataFrame) -> pd.DataFrame:
    """For each token that a batch asked for, how many classes have it."""
    let_go("ngram_jaccard")
    parts = [np.frombuffer(x, np.int64) for x in g["tokens"]]
    every = np.concatenate(parts)
    times = np.concatenate([_unpacked(x, y, len(p)) for x, y, p in zip(g["twice"], g["times"], parts)])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(np.r_[first, len(every)]))
    ends = np.cumsum([len(p) for p in parts])
    packed = [_packed(total[e - len(p):e]) for e, p in zip(ends, parts)]
    return g[["part", "batch"]].assign(twice=[x[0] for x in packed], times=[x[1] for x in packed], n=[len(p) for p in parts])


def _keep_shared(percent: int):
    def run(key, g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        let_go("ngram_jaccard")
        rows, sizes, prefixes = _classes_of(g)
        flat, lengths = np.concatenate(prefixes), np.array([len(p) for p in prefixes])
        owner = np.repeat(np.arange(len(rows)), lengths)
        tokens, at = np.unique(flat, return_inverse=True)
        answers = answers.sort_values("part")
        total = np.concatenate([_unpacked(x, y, n) for x, y, n in zip(answers["twice"], answers["times"], answers["n"])])
        assert len(total) == len(tokens), "a batch changed between its question and the answer"
        length = total[at]
        shared = length > 1
        # a class with too few shared tokens for any partner is out
        enough = np.bincount(owner[shared], minlength=len(rows)) >= np.maximum(1, np.ceil(np.ceil(sizes * percent / 100) / NEED))
        support = np.bincount(owner[shared], length[shared], minlength=len(rows)) / sizes
        kept = shared & enough[owner]
        who = owner[kept]
        return pd.DataFrame({"token": flat[kept], "cls": rows[who], "size": sizes[who], "support": support[who]})

    return run


def shared_tokens(prefixes: DataFrame, percent: int) -> DataFrame:
    """``(token, cls, size, support)``: the prefix tokens that two classes have
    or more, of the classes that share enough of them, from ``prefixes(row,
    digest, size, prefix)``. ``support`` is the mean length of the class's lists
    for its size. Rows of a class meet in one batch, at most one of a partition."""
    told = prefixes.where("prefix IS NOT NULL")
    total = told.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BATCH_TOKENS))
    batched = told.withColumn("batch", F.pmod(F.xxhash64(F.lit(23), "digest"), F.lit(n))).repartition(n, "batch")
    asked = batched.groupBy("batch").applyInPandas(_ask_shared(n), "part int, batch long, tokens binary, twice binary, times binary")
    answers = asked.groupBy("part").applyInPandas(_answer_shared, "part int, batch long, twice binary, times binary, n long")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        _keep_shared(percent), "token long, cls long, size int, support double")


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A bit per value of a digest's first three bytes: FILTER_BITS / 8 bytes,
    whatever the number of digests."""
    words = digests.selectExpr("cast(conv(substring(hex(digest), 1, 6), 16, 10) as int) AS word") \
        .selectExpr("shiftright(word, 6) AS at", "shiftleft(1L, word & 63) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[words["at"].to_numpy("int64")] = words["bits"].to_numpy("int64")
    return out.view("u1")


def _alike(size_a: Column, size_b: Column, percent: int) -> Column:
    return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar. A class that many ask for is
    dealt out over salted keys, one for every ``TILE`` of them; there are few
    such classes, and the list of them is broadcast."""
    n = pairs.count()
    asked = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > max(LEAST_HOT, n // HOT_GROUPS))
    hot = F.broadcast(durable(asked.select("b", F.ceil(F.col("n") / TILE).cast("int").alias("salts")), "hot"))
    salts = F.coalesce("salts", F.lit(1))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")).join(hot, "b", "left") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    left = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("salts") \
        .join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return left.join(right.hint("merge"), ["b", "salt"]).where(
        shared * 100 >= (F.size("ta") + F.size("tb") - shared) * percent).select("a", "b")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``row, id, size, component``: the size of its set and the
    smallest id among the rows that links of at least ``percent`` of a hundred
    reach. ``row`` tells rows with equal ids apart and names no text."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _found(texts, n, percent).select("row", "id", "size", "component")


def _found(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """:func:`near_components` of ``texts(row, id, text)``, with ``root``: one
    row number for each component, also where its rows have no id or share one
    with others. A row without a word is a root of its own."""
    spark = texts.sparkSession
    width = shuffle_width(spark)
    frequent = hot_tokens(texts.select("text"), n)
    hot = spark.sparkContext.broadcast((frequent["token"].to_numpy(), frequent["rank"].to_numpy()))
    rows = durable(texts.mapInPandas(_prefixes(n, percent, hot), "row long, id long, size long, digest binary, prefix array<long>"), "prefixes")

    classes = durable(with_group_facts(
        rows.where("digest IS NOT NULL").select("row", "id", "digest", "size"), ["digest"], [F.col("row")],
        {"cls": F.min("row"), "low": F.min("id"), "n": F.count("*")}, {"cls": F.min("cls"), "low": F.min("low"), "n": F.sum("n")}, width,
    ).select("row", "id", "digest", "size", "cls", "low", "n"), "classes")
    firsts = classes.where("row = cls").select("cls", "digest", "size", "low", "n")

    lists = durable(shared_tokens(rows.select("row", F.col("size").cast("int").alias("size"), "digest", "prefix"), percent), "lists")

    # the sets of the classes that share enough prefix tokens with others
    asked = lists.select("cls").distinct().join(firsts, "cls").select("cls", "digest")
    asked = durable(asked, "asked")
    wanted = spark.sparkContext.broadcast(_filter_of(asked))
    sets = texts.select("text").mapInPandas(_sets(n, wanted), "digest binary, tokens array<long>") \
        .groupBy("digest").agg(F.first("tokens").alias("tokens")).join(asked.hint("merge"), "digest").select("cls", "tokens")
    sets = durable(sets, "sets")

    # groups: every class and its leader
    first = lists.groupBy("token").agg(F.max(F.struct("support", F.bitwise_not("cls").alias("not_cls"), "size")).alias("first"), F.count("*").alias("n"))
    leaders = first.select("token", F.bitwise_not("first.not_cls").alias("leader"), F.col("first.size").alias("l_size"), "n")
    led = join_facts(lists, durable(leaders, "leaders"), ["token"], lists.count()) \
        .where("cls <> leader").where(_alike(F.col("size"), F.col("l_size"), percent)) \
        .groupBy("cls", "leader").agg(F.count("*").alias("n"), F.first(F.least("size", "l_size")).alias("less")) \
        .where(F.col("n") >= _need(F.col("less"))).groupBy("cls").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    led = durable(led, "led")
    links = durable(_verified(led.select(F.col("cls").alias("a"), F.col("leader").alias("b")), sets, percent), "links")
    component = connected_components(links).select(F.col("node").alias("cls"), "component")
    placed = asked.select("cls").join(firsts.select("cls", F.col("size").cast("int").alias("size")), "cls") \
        .join(_roots(led), "cls", "left").join(component, "cls", "left") \
        .select("cls", "size", F.coalesce("root", "cls").alias("grp"), F.coalesce("component", "cls").alias("comp"))
    placed = durable(_joined(lists.select("token", "cls"), durable(placed, "placed"), percent), "placed")
    heads = placed.where("cls = grp").select("grp", F.col("comp").alias("head"))
    members = durable(placed.join(heads, "grp", "left").withColumn("settled", F.col("comp").eqNullSafe(F.col("head"))).drop("head"), "members")
    more = _between(lists.select("token", "cls"), members, sets, percent)
    component = durable(connected_components(durable(links.unionByName(more), "links")), "components")
    for used in (lists, sets, asked, led, members):
        discard(used)

    # names: the smallest id of all rows of all classes of a component
    named = firsts.select("cls", "low", "n").join(component.select(F.col("node").alias("cls"), "component"), "cls", "left") \
        .withColumn("component", F.coalesce("component", "cls"))
    names = with_group_facts(named, ["component"], [F.col("cls")], {"name": F.min("low")}, {"name": F.min("name")}, width) \
        .select("cls", "name", F.col("component").alias("root"), "n")
    found = join_facts(classes.drop("n"), durable(names, "names"), ["cls"], classes.count()) \
        .select("row", "id", "size", F.col("name").alias("component"), "root")
    empty = rows.where("digest IS NULL").select("row", "id", "size", F.col("id").alias("component"), F.col("row").alias("root"))
    return found.unionByName(empty)


def _roots(led: DataFrame) -> DataFrame:
    """``(cls, root)``: leaders of leaders, eight steps up. Support rises along
    the way, so there are no circles; a longer way ends in a group of its own."""
    up = led.select("cls", F.col("leader").alias("root"))
    for _ in range(3):
        again = up.select(F.col("cls").alias("root"), F.col("root").alias("further"))
        up = durable(up.join(again, "root", "left").select("cls", F.coalesce("further", "root").alias("root")), "roots")
    return up


def _joined(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """``placed`` with the classes that are groups of their own moved to larger
    ones. A token names the largest group whose union has it, one row whatever
    the number of groups; a lone class follows the group that most of its tokens
    name, if that is ``need`` of them. A lone class may follow another one, which
    always ranks higher, so there are no circles here either."""
    weights = placed.groupBy("grp").agg(F.count("*").alias("weight"), F.min("size").alias("least"), F.max("size").alias("most"))
    held = durable(lists.join(placed.join(weights, "grp").hint("merge"), "cls").select("token", "cls", "size", "grp", "weight", "least", "most"), "held")
    best = held.groupBy("token").agg(F.max(F.struct("weight", F.bitwise_not("grp").alias("not_grp"), "least", "most")).alias("g")) \
        .select("token", F.bitwise_not("g.not_grp").alias("leader"), *[F.col(f"g.{c}").alias(f"g_{c}") for c in ("weight", "least", "most")])
    bound = _bound(percent)
    moved = held.where("weight = 1").join(best.hint("merge"), "token").where("grp <> leader").where(_in_range(percent)) \
        .groupBy("cls", "leader").agg(F.count("*").alias("n"), F.first("g_weight").alias("g_weight"), F.first(bound).alias("bound")).where("n >= bound") \
        .groupBy("cls").agg(F.max_by("leader", F.struct("n", "g_weight", -F.col("leader"))).alias("leader"))
    roots = _roots(durable(moved, "moved"))
    return placed.join(roots, "cls", "left").select("cls", "size", F.coalesce("root", "grp").alias("grp"), "comp")


def _bound(percent: int) -> Column:
    """Prefix tokens of a class that the union of a group ``g_`` must have."""
    return _need(F.least(F.col("size"), F.greatest("g_least", F.col("size") * percent / 100)))


def _in_range(percent: int) -> Column:
    """Whether a class can be similar to any member by its size."""
    return (F.col("size") * percent <= F.col("g_most") * 100) & (F.col("g_least") * percent <= F.col("size") * 100)


def _between(lists: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, by way of the token-group matrix."""
    weights = members.groupBy("grp").agg(F.count("*").alias("weight"), F.min("size").alias("least"), F.max("size").alias("most"),
                                         F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("one"))
    known = members.join(weights, "grp")
    held = lists.join(known.hint("merge"), "cls").select("token", "cls", "size", "comp", "grp", "weight", "least", "most", "one")
    held = durable(held, "held")
    columns = held.groupBy("token", "grp").agg(F.first("weight").alias("weight"), F.first("least").alias("least"), F.first("most").alias("most"), F.first("one").alias("one"))
    several = columns.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    columns = columns.join(several, "token").select("token", *[F.col(c).alias(f"g_{c}") for c in ("grp", "weight", "least", "most", "one")])
    bound = _bound(percent)
    opened = held.join(columns.hint("merge"), "token").where("grp <> g_grp").where(
        "weight < g_weight OR weight = g_weight AND grp < g_grp"
    ).where("g_one IS NULL OR g_one <> comp").where(_in_range(percent)).groupBy(
        "cls", F.col("g_grp").alias("grp")).agg(F.count("*").alias("n"), F.first(bound).alias("bound")).where("n >= bound").select("cls", "grp")
    own = members.where("NOT settled").select("cls", "grp")
    asking = durable(opened.union(own).join(members.select("cls", "comp"), "cls"), "asking")
    return _opened(asking, members, sets, percent)


def _opened(asking: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compares ``asking(cls, grp, comp)`` with the members of the groups, tile by tile."""
    tiles = F.ceil(F.count("*") / TILE).cast("int")
    a_tiles = asking.groupBy("grp").agg(tiles.alias("a_tiles"))
    b_tiles = members.join(a_tiles, "grp").groupBy("grp").agg(tiles.alias("b_tiles"), F.first("a_tiles").alias("a_tiles"))
    own = lambda n: F.pmod(F.xxhash64(F.lit(29), "cls"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(b_tiles, "grp").withColumn("x", own("a_tiles")).withColumn("y", other("b_tiles")).select("grp", "x", "y", "cls", "comp", F.lit(True).alias("asks"))
    right = members.join(b_tiles, "grp").withColumn("y", own("b_tiles")).withColumn("x", other("a_tiles")).select("grp", "x", "y", "cls", "comp", F.lit(False).alias("asks"))
    # many small groups share a task and a call, tiles of one group do not
    tiled = durable(left.unionByName(right), "tiles")
    calls = max(1, -(-tiled.count() // CALL_ROWS))
    many = tiled.join(sets.hint("merge"), "cls").withColumn("call", F.pmod(F.xxhash64("grp", "x", "y"), F.lit(calls)))
    return many.groupBy("call").applyInPandas(_compare(percent), "a long, b long")


def _compare(percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        let_go("ngram_jaccard")
        out = []
        for _, tile in g.groupby(["grp", "x", "y"], sort=False):
            asks = tile["asks"].to_numpy()
            a, b = tile[asks], tile[~asks]
            if not len(a) or not len(b):
                continue
            b_cls, b_comp, b_size = b["cls"].to_numpy(), b["comp"].to_numpy(), b["tokens"].map(len).to_numpy()
            flat, owner = np.concatenate(b["tokens"].tolist()), np.repeat(np.arange(len(b)), b_size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for cls, comp, tokens in zip(a["cls"], a["comp"], a["tokens"]):
                low, high = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(b))
                alike = (shared * 100 >= (len(tokens) + b_size - shared) * percent) & (b_comp != comp)
                _, first = np.unique(b_comp[alike], return_index=True)
                out += [(cls, x) for x in b_cls[alike][first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id, and
    of rows that share it the first. Rows are found again by a durable number,
    so null and repeated ids of unlike documents all stay. Rows without a word
    link with nothing and stay."""
    row_col = free_name(docs, "row")
    docs_once = numbered(docs, row_col)
    found = _found(docs_once.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(row_col))
    return docs_once.join(kept, row_col).select(*docs.columns)
