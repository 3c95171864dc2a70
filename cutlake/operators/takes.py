"""Shot search, script-to-take matching and story operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.distance import prefix_distances
from cutlake.functions.greedy import spaced_picks
from cutlake.functions.ordered import following, max_before, previous, row_index, running_sum, scan, sorted_groups
from cutlake.functions.staging import settle
from cutlake.functions.text import levenshtein_ratio, normalize, prefix_matches, words

# Thresholds, weights, word lists and keyword tables.
HERO_FLOOR, HERO_BONUS = 0.5, 0.2
BROADCAST_ROWS = 200_000
#: Places of a query that fit the bits of one number.
PLACES = 63
HERO_QUERIES = ("hero", "held")
MATCH, FLUFF, RESTART, MAX_WINDOW, MERGE_GAP = 0.55, 0.3, 0.8, 6, 1.5
SLUG_WORDS = ("int", "ext", "day", "night", "i", "e")
OUTDOOR = (
    "forest", "wald", "woods", "road", "straße", "strasse", "street", "mountain", "berg", "sky", "himmel", "field", "feld", "meadow",
    "wiese", "beach", "strand", "river", "fluss", "lake", "tree", "baum", "outdoor", "outside", "landscape", "landschaft", "trail",
    "path", "garden", "garten",
)
INDOOR = (
    "room", "zimmer", "kitchen", "küche", "kueche", "interior", "indoor", "inside", "office", "büro", "buero", "wall", "wand", "table",
    "tisch", "sofa", "couch", "bed", "bett", "corridor", "flur", "hallway", "stairs", "treppe", "ceiling", "basement", "keller", "desk",
    "lamp", "lampe",
)
NIGHT = (
    "night", "nacht", "dark", "dunkel", "dusk", "dämmerung", "daemmerung", "evening", "abend", "moon", "mond", "headlight",
    "scheinwerfer",
)
DAY = (
    "day", "tag", "sunny", "sonnig", "daylight", "tageslicht", "sun", "sonne", "bright", "hell", "morning", "morgen", "noon", "mittag",
    "afternoon", "nachmittag",
)
WEAK_USABLE, OK_SCORE = 0.4, 0.75
SCENE_BASE, SCENE_PER_LINE, SCENE_ACTION_MAX, SCENE_WORDS, SCENE_MIN, SCENE_MAX = 6.0, 2.5, 10.0, 4.0, 4.0, 45.0
CALM_WORDS, FAST_WORDS = ("ruhig", "calm", "langsam", "slow"), ("schnell", "fast", "hektisch", "snappy")
HARD_WORDS, SOFT_WORDS = ("harter schnitt", "harte schnitte", "hard cut"), ("blende", "dissolve", "weich")
PACES = {"calm": 3.0, "default": 2.0, "fast": 1.0}
DEDUP_BITS = 6
SEED_HERO, SEED_HIGHLIGHT, SEED_GAP = 0.5, 0.25, 8.0
CROSS_CLIP = 1e6
LOOK = {"base": 1.0, "daylight": 1.0, "shot_size": 0.5, "grp": 1.0, "tag": 0.25}
ACTIVE_FROM, SIZE_WEIGHT = 2, 0.08
SHOT_SIZES = ("wide", "medium", "close")
EPS = 1e-6
#: A cursor that a move leaves where it is.
STAY = -1


# -- search ------------------------------------------------------------------------------------------------


def spoken_shots(segments: DataFrame) -> DataFrame:
    """Non-empty transcript lines as searchable shots; the id is the take's and the line's number."""
    text = F.trim("text")
    return segments.where(text != "").select(
        F.concat_ws(":", F.lit("line"), F.col("take_id").cast("string"), F.col("seg").cast("string")).alias("shot_id"),
        F.col("take_id").cast("string").alias("clip_path"), "start_s", "end_s", text.alias("label"), F.array().cast("array<string>").alias("tags"),
        F.lit("").alias("role"), F.lit(0.0).alias("hero"), F.lit("").alias("grp"), F.lit(True).alias("spoken"),
    )


def searchable(annotations: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """Annotated and spoken shots in one table; every shot has its own ``shot_id``."""
    seen = annotations if "spoken" in annotations.columns else annotations.withColumn("spoken", F.lit(False))
    return seen if spoken is None else seen.unionByName(spoken, allowMissingColumns=True)


def shot_words(shots: DataFrame, row: list[str]) -> DataFrame:
    """Distinct words of each shot: label, tags, group and role."""
    return shots.select(*row, F.explode(F.array_distinct(_shot_text_words())).alias("word"))


def _shot_text_words() -> Column:
    return words(F.concat_ws(" ", F.col("label"), F.array_join("tags", " "), F.col("grp"), F.col("role")))


def search(shots: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Best shots for a table of queries (query_id, query): share of query words found plus a hero bonus.

    Query words meet the distinct vocabulary first. Shots are dealt out once, by their id and with their distinct words, so that hits
    are counted where a shot lies and only the best ``limit`` of every query leave a partition. The places of a query that a word
    finds are the bits of one number, so a shot keeps one row per query and ``PLACES`` places while its words are counted. The table of
    matching words is broadcast while it is small. The special queries "hero" and "held" list hero shots instead.
    """
    special = F.lower(F.trim("query")).isin(*HERO_QUERIES)
    asked = settle(queries.where(~special).select("query_id", F.posexplode(words("query")).alias("pos", "token")))
    size = asked.groupBy("query_id").agg(F.count("*").alias("__n"))
    row = ["shot_id", "clip_path", "start_s", "end_s", "hero"]
    listed = shots.select(*row, F.array_distinct(_shot_text_words()).alias("__words"))
    dealt = listed.groupBy("shot_id").agg(F.first(F.struct(*row[1:])).alias("r"), F.array_distinct(F.flatten(F.collect_list("__words"))).alias("__words"))
    pairs = prefix_matches(asked, shot_words(shots, []))
    wanted = settle(asked.join(pairs, "token").groupBy("word", "query_id", F.floor(F.col("pos") / PLACES).alias("__block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {PLACES})")).alias("__mask")
    ))
    few = wanted.count() <= BROADCAST_ROWS
    met = dealt.select("shot_id", "r.*", F.explode("__words").alias("word")).join(F.broadcast(wanted) if few else wanted, "word")
    hits = met.groupBy(*row, "query_id", "__block").agg(F.bit_or("__mask").alias("__mask"))
    hits = hits.groupBy(*row, "query_id").agg(F.sum(F.bit_count("__mask")).alias("__hits"))
    rel = F.least(F.lit(1.0), F.col("__hits") / F.col("__n") + HERO_BONUS * F.col("hero"))
    found = hits.join(F.broadcast(size) if few else size, "query_id").select("query_id", *row, rel.alias("relevance"))
    heroes = top_heroes(shots.select(*row), limit).withColumn("__k", F.lit(1))
    held = queries.where(special).select("query_id", F.lit(1).alias("__k")).join(heroes, "__k").select("query_id", *row, F.col("hero").alias("relevance"))
    order = Window.partitionBy("query_id").orderBy(F.round("relevance", 9).desc(), F.desc("hero"), "clip_path", "start_s", "shot_id")
    ranked = found.unionByName(held).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # The texts of the shots that were chosen, and nothing else, are fetched at the end.
    texts = shots.select("shot_id", "label", "spoken") if "spoken" in shots.columns else shots.select("shot_id", "label", F.lit(False).alias("spoken"))
    chosen = ranked.withColumn("rank", F.col("rank").cast("bigint"))
    return (F.broadcast(chosen) if few else chosen).join(texts, "shot_id")


def top_heroes(shots: DataFrame, limit: int = 20) -> DataFrame:
    """The hero query: shots with hero ≥ 0.5, strongest first."""
    return shots.where(F.col("hero") >= HERO_FLOOR).orderBy(F.desc("hero"), "clip_path", "start_s", "shot_id").limit(limit)


# -- script lines and takes ------------------------------------------------------------------------------------


def scene_key(number: Column) -> Column:
    """Scene number without case and leading zeros."""
    v = F.lower(F.trim(number))
    bare = F.regexp_replace(v, "^0+", "")
    return F.when(bare != "", bare).when(v != "", F.lit("0")).otherwise("")


def candidate_takes(scenes: DataFrame, takes: DataFrame, script: str = "script_id") -> DataFrame:
    """(script, scene_no, take_id): hinted takes for their scene, unhinted takes for every scene of their script."""
    s = scenes.select(script, "scene_no", scene_key(F.col("number")).alias("__k"))
    t = takes.select(script, "take_id", scene_key(F.coalesce("scene_hint", F.lit(""))).alias("__k"))
    hinted = t.where(F.col("__k") != "").join(s.where(F.col("__k") != ""), [script, "__k"]).select(script, "scene_no", "take_id")
    free = t.where(F.col("__k") == "").select(script, "take_id").join(s.select(script, "scene_no"), script)
    return hinted.unionByName(free.select(script, "scene_no", "take_id"))


def take_windows(segments: DataFrame, max_window: int = MAX_WINDOW) -> DataFrame:
    """Every run of 1..max_window consecutive segments of a take: (take_id, i, width, text, start_s, end_s).

    ``i`` counts segments from 0; the running text skips segments that are empty after normalisation.
    """
    rows = segments.select("take_id", "i", normalize("text").alias("norm"), F.trim("text").alias("raw"), "start_s", "end_s")
    # Each segment is copied to the windows it can belong to; a window has at most max_window rows.
    back = F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("i") - (max_window - 1)), F.col("i").cast("bigint")))
    spread = rows.withColumn("first", back)
    packed = spread.groupBy("take_id", "first").agg(F.array_sort(F.collect_list(F.struct("i", "norm", "raw", "start_s", "end_s"))).alias("l"))
    wide = packed.select("take_id", F.col("first").alias("i"), "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("width"))
    part = F.slice("l", 1, F.col("width"))
    text = F.array_join(F.filter(F.transform(part, lambda x: x["norm"]), lambda s: s != ""), " ")
    return wide.select(
        "take_id", "i", "width", text.alias("norm"), F.concat_ws(" ", F.transform(part, lambda x: x["raw"])).alias("text"),
        F.element_at(part, 1)["start_s"].alias("start_s"), F.element_at(part, -1)["end_s"].alias("end_s"),
    )


#: Segments a tile of a take begins with, and script lines of a tile: what one row sends to be compared.
TILE = 16
#: What a task compares at once: pairs of lines and places, and letters of their windows.
PAIRS, LETTERS = 1 << 15, 1 << 24


def line_windows(
    lines: DataFrame, segments: DataFrame, routes: DataFrame, threshold: float = MATCH, single: float = FLUFF, max_window: int = MAX_WINDOW, texts: bool = True,
) -> DataFrame:
    """Similarity of dialogue lines and take windows of the same scene, kept where a later step can use it.

    ``lines`` has (scene_id, line_no, text), ``segments`` what :func:`take_windows` reads, ``routes`` (scene_id, take_id).
    Windows of one segment are kept from ``single`` on, longer ones from ``threshold`` on; lengths rule out pairs that
    cannot get there. Similarity is 1 - edit distance / longer length. Without ``texts`` windows come without their text (:func:`window_texts`).

    Lines and segments meet as tiles, so a text is sent once for each ``TILE`` of its partners, and one walk along the
    segments from a place on gives the distances of all windows that begin there.
    """
    said = lines.select("scene_id", "line_no", normalize("text").alias("line")).where(F.col("line") != "")
    heard = segments.select("take_id", F.col("i").cast("bigint").alias("i"), normalize("text").alias("norm"))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - (max_window - 1)) / TILE))
    heard = heard.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("i") / TILE))))
    pieces = F.array_sort(F.collect_list(F.struct("i", "norm")))
    heard = heard.groupBy("take_id", "block").agg(pieces.alias("p")).select("take_id", "block", F.col("p.i").alias("places"), F.col("p.norm").alias("heard"))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    said = said.groupBy("scene_id", F.floor(F.col("line_no") / TILE).alias("page")).agg(pieces.alias("p"))
    said = said.select("scene_id", "page", F.col("p.line_no").alias("numbers"), F.col("p.line").alias("said"))
    tiles = routes.select("scene_id", "take_id").join(heard, "take_id").join(said, "scene_id")
    # Comparing is the costly part and its input small, so it is spread over the cores instead of coalesced.
    spark = lines.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = tiles.repartition(parts, "scene_id", "take_id", "block", "page").drop("page")
    kind = {f.name: f.dataType.simpleString() for f in [*lines.schema.fields, *routes.schema.fields]}
    schema = f"scene_id {kind['scene_id']}, take_id {kind['take_id']}, line_no {kind['line_no']}, i bigint, width int, similarity double"
    scored = tiles.mapInPandas(_tile_scores(threshold, single, max_window), schema)
    # Times are all that the segments are sent for once more; their texts follow only where a window was kept.
    times = segments.select("take_id", F.col("i").cast("bigint").alias("i"), "start_s", "end_s")
    back = F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("i") - (max_window - 1)), F.col("i")))
    times = times.withColumn("first", back).groupBy("take_id", F.col("first").alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("j"), "start_s", "end_s"))).alias("l"))
    timed = scored.join(times, ["take_id", "i"]).where(F.col("width") <= F.size("l"))
    timed = timed.select(
        "scene_id", "take_id", "line_no", "i", "width", "similarity", F.element_at("l", 1)["start_s"].alias("start_s"), F.element_at("l", F.col("width"))["end_s"].alias("end_s"),
    )
    return window_texts(timed, segments, max_window) if texts else timed


def window_texts(windows: DataFrame, segments: DataFrame, max_window: int = MAX_WINDOW) -> DataFrame:
    """``windows`` (take_id, i, width, …) with their ``text`` as :func:`take_windows` has it; a segment is sent to the windows that need it."""
    wanted = windows.select("take_id", F.col("i").alias("first")).distinct()
    wanted = wanted.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("first") + (max_window - 1))))
    rows = segments.select("take_id", F.col("i").cast("bigint").alias("i"), normalize("text").alias("norm"), F.trim("text").alias("raw"))
    near = rows.join(wanted, ["take_id", "i"]).groupBy("take_id", F.col("first").alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("j"), "norm", "raw"))).alias("__l"))
    text = F.concat_ws(" ", F.transform(F.slice("__l", 1, F.col("width")), lambda x: x["raw"]))
    return windows.join(near, ["take_id", "i"]).select(*windows.columns, text.alias("text"))


def _tile_scores(threshold: float, single: float, max_window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    least = np.full(max_window, threshold)
    least[0] = min(single, threshold)

    def windows_of(block: int, places: np.ndarray, heard: np.ndarray) -> Iterator[tuple[int, str, np.ndarray]]:
        for k, i in enumerate(places):
            if not block * TILE <= i < (block + 1) * TILE:
                continue
            text, ends = "", []
            for n in range(k, min(k + max_window, len(places))):
                if places[n] != i + n - k:
                    break
                text = f"{text} {heard[n]}" if text and heard[n] else text or heard[n]
                ends.append(len(text))
            yield int(i), text, np.array(ends, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pairs, letters = [], 0, 0
        for batch in batches:
            for tile in batch[["scene_id", "take_id", "block", "places", "heard", "numbers", "said"]].itertuples(index=False, name=None):
                held.append(tile)
                pairs += len(tile[3]) * len(tile[5])
                letters += max_window * sum(map(len, tile[4]))
                if pairs >= PAIRS or letters >= LETTERS:
                    yield scores(held)
                    held, pairs, letters = [], 0, 0
        if held:
            yield scores(held)

    def scores(tiles: list[tuple]) -> pd.DataFrame:
        texts, lines, text_of, line_of, ends, rows = [], [], [], [], [], []
        for scene, take, block, places, heard, numbers, said in tiles:
            sizes = np.array([len(s) for s in said], np.int64)
            for i, text, upto in windows_of(block, places, heard):
                short, long_ = np.minimum(upto, sizes[:, None]), np.maximum(upto, sizes[:, None])
                near = (short > 0) & (short / np.maximum(long_, 1) >= least[: len(upto)] - 1e-12)
                for n in np.flatnonzero(near.any(axis=1)):
                    line_of.append(len(lines) + n)
                    text_of.append(len(texts))
                    width = np.flatnonzero(near[n])
                    ends.append(upto[width])
                    rows.append((scene, take, numbers[n], i, width + 1, long_[n, width]))
                texts.append(text)
            lines += list(said)
        if not rows:
            return pd.DataFrame({c: [] for c in ("scene_id", "take_id", "line_no", "i", "width", "similarity")})
        away = prefix_distances(lines, texts, np.array(line_of), np.array(text_of), np.array([e[-1] for e in ends]), ends)
        many = [len(e) for e in ends]
        width = np.concatenate([r[4] for r in rows])
        similarity = 1 - np.concatenate(away) / np.concatenate([r[5] for r in rows])
        out = pd.DataFrame({c: np.repeat(np.array([r[k] for r in rows]), many) for k, c in enumerate(("scene_id", "take_id", "line_no", "i"))})
        return out.assign(width=width, similarity=similarity)[similarity >= least[width - 1]]

    return run


#: Script lines whose walk one task does at a time.
WALK_LINES = 512


def match_lines(pairs: DataFrame, threshold: float = MATCH, walk_lines: int = WALK_LINES) -> DataFrame:
    """Lines in script order, each on its best window at or after the previous match (ties: earliest, shortest).

    Adds ``from_i``, where the search for the line began. Each line moves a cursor along the take, from anywhere to the
    best window from there on: a step function that never falls. The functions of ``walk_lines`` lines are composed
    into one, the cursor goes from block to block through these, and then every block is walked from where its
    cursor stands. No task holds more of a scene than one block.
    """
    good = pairs.where(F.col("similarity") >= threshold).withColumn("__block", F.floor(F.col("line_no") / walk_lines))
    keys, order = ["scene_id", "take_id", "__block"], ["line_no", "__away", "i", "width"]
    good = good.withColumn("__away", -F.col("similarity"))
    kind = {f.name: f.dataType.simpleString() for f in good.schema.fields}
    named = ", ".join(f"{k} {kind[k]}" for k in keys)
    dealt = good.select(*keys, "line_no", "__away", F.col("i").cast("bigint").alias("i"), "width").repartition(*keys).sortWithinPartitions(*keys, *order)
    moves = dealt.mapInPandas(_block_moves(keys), f"{named}, upto array<bigint>, to array<bigint>")
    # One row per block; the cursor of a scene in a take passes them one by one.
    moves = moves.repartition(*keys[:2]).sortWithinPartitions(*keys)
    starts = moves.mapInPandas(_cursors(keys), f"{named}, __cursor bigint")
    walked = good.join(starts, keys).repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = [c for c in pairs.columns]
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in columns], "from_i bigint"])
    return walked.mapInPandas(_walk(keys, columns), schema).withColumn("width", F.col("width").cast("int"))


def _lines_of(lines: np.ndarray, begin: int, end: int) -> Iterator[slice]:
    line = lines[begin:end]
    new = begin + np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    return (slice(a, b) for a, b in zip(new, np.r_[new[1:], end]))


def move_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a cursor goes from any place, by the places of a line's windows from the best down: (up to, to); beyond the last it stays."""
    best = np.maximum.accumulate(places)
    first = np.r_[True, best[1:] > best[:-1]]
    return places[first], places[first]


def composed(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The move g after f; ``to`` is STAY where a cursor stays."""
    upto = np.union1d(f[0], g[0])

    def after(move: tuple[np.ndarray, np.ndarray], cursor: np.ndarray) -> np.ndarray:
        at = np.searchsorted(move[0], cursor)
        return np.where(at < len(move[0]), np.r_[move[1], STAY][at], STAY)

    first = after(f, upto)
    then = after(g, np.where(first == STAY, upto, first))
    to = np.where(then == STAY, first, then)
    last = np.r_[(to[1:] != to[:-1]) | (to[1:] == STAY), True]
    return upto[last], to[last]


def _block_moves(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in sorted_groups(batches, keys):
            places, lines, moves = rows["i"].to_numpy(), rows["line_no"].to_numpy(), []
            for a, b in zip(begins, np.r_[begins[1:], len(rows)]):
                move = None
                for line in _lines_of(lines, a, b):
                    own = move_of(places[line])
                    move = own if move is None else composed(move, own)
                moves.append(move)
            yield rows[keys].iloc[begins].assign(upto=[m[0] for m in moves], to=[m[1] for m in moves])

    return run


def _cursors(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scene, cursor = None, 0
        for batch in batches:
            starts = []
            for *key, upto, to in batch[[*keys[:2], "upto", "to"]].itertuples(index=False):
                if key != scene:
                    scene, cursor = key, 0
                starts.append(cursor)
                at = int(np.searchsorted(upto, cursor))
                if at < len(upto) and to[at] != STAY:
                    cursor = int(to[at])
            yield batch[keys].assign(__cursor=starts)

    return run


def _walk(keys: list[str], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in sorted_groups(batches, keys):
            places, lines, cursors = rows["i"].to_numpy(), rows["line_no"].to_numpy(), rows["__cursor"].to_numpy()
            hits, begun = [], []
            for a, b in zip(begins, np.r_[begins[1:], len(rows)]):
                cursor = int(cursors[a])
                for line in _lines_of(lines, a, b):
                    ahead = np.flatnonzero(places[line] >= cursor)
                    if len(ahead):
                        hits.append(line.start + ahead[0])
                        begun.append(cursor)
                        cursor = int(places[hits[-1]])
            yield rows.iloc[hits][columns].assign(from_i=np.array(begun, np.int64))

    return run


def fluffs(pairs: DataFrame, matches: DataFrame, segments: DataFrame, routes: DataFrame, threshold: float = MATCH, low: float = FLUFF) -> DataFrame:
    """Flagged segments (scene_id, take_id, i): weak tries before a better match, and aborts that start over."""
    tries = pairs.where((F.col("width") == 1) & (F.col("similarity") >= low) & (F.col("similarity") < threshold)).select(
        "scene_id", "take_id", "line_no", F.col("i").alias("j"), F.col("similarity").alias("__s")
    )
    found = matches.select("scene_id", "take_id", "line_no", "i", "from_i", "similarity")
    weak = tries.join(found, ["scene_id", "take_id", "line_no"]).where(
        (F.col("j") >= F.col("from_i")) & (F.col("j") < F.col("i")) & (F.col("__s") < F.col("similarity"))
    ).select("scene_id", "take_id", F.col("j").alias("i"))
    # Of a text only its first three words and how it ends are sent on.
    head = F.slice(F.split(normalize("text"), " "), 1, 3)
    trails = F.rtrim("text").endswith("--") | F.rtrim("text").endswith("...")
    rows = segments.select("take_id", "i", trails.alias("__trails"), F.when(F.size(head) >= 3, F.array_join(head, " ")).alias("a"))
    cut = scan(rows, ["take_id"], ["i"], F.floor(F.col("i") / 1024), b=following("a")).where(F.col("__trails") & F.col("a").isNotNull() & F.col("b").isNotNull())
    again = cut.where(levenshtein_ratio("a", "b") >= RESTART).select("take_id", "i")
    restarts = routes.join(again, "take_id").select("scene_id", "take_id", "i")
    return weak.unionByName(restarts).distinct()


def take_scores(matches: DataFrame, flagged: DataFrame, lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Coverage, accuracy, fluffs, seconds and total per scene and take, ranked within the scene."""
    size = lines.groupBy("scene_id").agg(F.count("*").alias("__lines"))
    hit = matches.groupBy("scene_id", "take_id").agg(
        F.count("*").alias("matched"), F.avg("similarity").alias("accuracy"), F.sum(F.col("end_s") - F.col("start_s")).alias("duration")
    )
    slips = flagged.groupBy("scene_id", "take_id").agg(F.count("*").alias("fluffs"))
    keys = ["scene_id", "take_id"]
    out = routes.join(size, "scene_id").join(hit, keys, "left").join(slips, keys, "left").fillna(0, ["matched", "fluffs"]).fillna(0.0, ["accuracy", "duration"])
    out = out.withColumn("coverage", F.col("matched") / F.col("__lines"))
    total = 0.6 * F.col("coverage") + 0.3 * F.col("accuracy") - 0.02 * F.least(F.col("fluffs"), F.lit(10))
    out = out.withColumn("total", total)
    # The takes of one scene.
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.round("total", 9).desc(), "take_id"))
    return out.select(*keys, "coverage", "accuracy", "fluffs", "duration", "total", rank.cast("bigint").alias("rank"))


def choose_lines(matches: DataFrame, scores: DataFrame, max_takes: int = 1, forced: DataFrame | None = None) -> DataFrame:
    """Lines of the best takes: each round the next take in order that adds lines supplies all it can.

    ``forced`` (scene_id, take_id) goes first where the take is a candidate.
    """
    order = scores.select("scene_id", "take_id", "rank")
    if forced is not None:
        order = order.join(forced.select("scene_id", "take_id", F.lit(0).alias("__f")), ["scene_id", "take_id"], "left")
        order = order.withColumn("rank", F.coalesce(F.col("__f").cast("bigint"), F.col("rank"))).drop("__f")
    left = settle(matches.join(order, ["scene_id", "take_id"]))
    chosen = None
    for n in range(max_takes):
        lead = left.groupBy("scene_id").agg(F.min("rank").alias("rank"))
        picked = settle(left.join(lead, ["scene_id", "rank"]).withColumn("take_order", F.lit(n + 1).cast("bigint")))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if n + 1 < max_takes:
            left = left.join(picked.select("scene_id", "line_no"), ["scene_id", "line_no"], "left_anti")
    return chosen.drop("rank")


def unmatched_lines(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    return lines.select("scene_id", "line_no").join(chosen.select("scene_id", "line_no"), ["scene_id", "line_no"], "left_anti")


def select_segments(chosen: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """Chosen lines in script order, merged while they stay in one take with pauses below ``gap`` seconds.

    A line opens a segment where the take changes, or where it starts ``gap`` or more after everything the lines of
    its stretch in that take have ended before it. Where the lines of such a run start one after the other, the run is one segment.
    Runs whose lines go back in time are walked line by line, with the segment's start and end carried along.
    """
    rows = chosen.select(
        "scene_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("take_id").cast("string").alias("take_id"), F.col("start_s").alias("s"), F.col("end_s").alias("e"), "text"
    )
    by_line = F.floor(F.col("line_no") / 1024)
    order = ["line_no"]
    rows = scan(rows, ["scene_id"], order, by_line, __p=previous("take_id"))
    rows = scan(rows.withColumn("__new", (~F.col("take_id").eqNullSafe(F.col("__p"))).cast("int")), ["scene_id"], order, by_line, __stretch=running_sum("__new"))
    stretch = ["scene_id", "__stretch"]
    rows = scan(rows, stretch, order, by_line, __top=max_before("e"), __s=previous("s"))
    opens = F.col("__top").isNull() | (F.col("s") - F.col("__top") >= gap)
    rows = scan(rows.withColumn("__new", opens.cast("int")), stretch, order, by_line, __run=running_sum("__new"))
    run = [*stretch, "__run"]
    back = rows.where(~opens & (F.col("s") < F.col("__s"))).select(*run).distinct()
    kind = dict(rows.dtypes)
    columns = [*run, "take_id", "s", "e", "line_no", "text"]
    plain = rows.select(*columns, F.lit(0).cast("bigint").alias("__part")).join(back, run, "left_anti")
    twisted = rows.select(*columns).join(back, run, "left_semi").repartition(*run).sortWithinPartitions(*run, "line_no")
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in columns], "__part bigint"])
    whole = plain.unionByName(twisted.mapInPandas(_parts(run, gap), schema))
    line = F.struct("line_no", "text")
    out = whole.groupBy(*run, "__part").agg(F.first("take_id").alias("take_id"), F.min_by("s", "line_no").alias("start_s"), F.max("e").alias("end_s"), F.array_sort(F.collect_list(line)).alias("l"))
    out = out.withColumn("__first", F.get("l", F.lit(0))["line_no"])
    out = scan(out, ["scene_id"], ["__first"], F.floor(F.col("__first") / 1024), segment_no=row_index())
    text = F.trim(F.array_join(F.transform("l", lambda x: x["text"]), " "))
    return out.select("scene_id", "segment_no", "take_id", "start_s", "end_s", F.transform("l", lambda x: x["line_no"]).alias("lines"), text.alias("text"))


def _parts(run: list[str], gap: float):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, start, end = None, 0, 0.0, 0.0
        for batch in batches:
            parts = []
            for *own, s, e in batch[[*run, "s", "e"]].itertuples(index=False):
                if own != key:
                    key, part, start, end = own, 0, s, e
                elif s >= start and s - end < gap:
                    end = max(end, e)
                else:
                    part, start, end = part + 1, s, e
                parts.append(part)
            yield batch.assign(__part=np.array(parts, np.int64))

    return walk


def assembly_coverage(chosen: DataFrame, lines: DataFrame, key: str | None = None) -> DataFrame:
    """Share of the dialogue the assembly covers, per ``key`` of the lines or over everything."""
    matched = chosen.select("scene_id", "line_no").distinct().withColumn("__m", F.lit(1))
    rows = lines.join(matched, ["scene_id", "line_no"], "left")
    agg = (F.count("__m") / F.count("*")).alias("coverage")
    return rows.groupBy(key).agg(agg) if key else rows.agg(agg)


# -- scenes -------------------------------------------------------------------------------------------------------


def scene_check(scenes: DataFrame, moments: DataFrame, clips: DataFrame, key: str = "folder") -> DataFrame:
    """Does the footage of a folder fit its scene: word overlap, INT/EXT and DAY/NIGHT by what the labels say.

    ``scenes`` has (scene_no, folder, heading, summary), ``moments`` (folder, label, tags, grp), ``clips``
    (folder, usable_ratio). Words meet on their first letters, never scene × vocabulary.
    """
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.array_join("tags", " "), F.coalesce("grp", F.lit("")))
    vocabulary = settle(moments.select(key, F.explode(F.array_distinct(words(text))).alias("word")).distinct())
    known = vocabulary.select(key).distinct().withColumn("content_checked", F.lit(True))
    lists = [("outdoor", OUTDOOR), ("indoor", INDOOR), ("night", NIGHT), ("day", DAY)]
    fixed = scenes.sparkSession.createDataFrame([(n, w) for n, ws in lists for w in ws], "list string, token string")
    hits = prefix_matches(fixed.select("token"), vocabulary.select("word")).join(fixed, "token").join(vocabulary, "word")
    votes = hits.groupBy(key).agg(*[F.count_distinct(F.when(F.col("list") == n, F.col("token"))).alias(f"__{n}") for n, _ in lists])
    tokens = scenes.select("scene_no", key, F.explode(F.array_distinct(words(F.concat_ws(" ", "heading", "summary")))).alias("token")).where(~F.col("token").isin(*SLUG_WORDS))
    tokens = settle(tokens)
    matched = tokens.join(prefix_matches(tokens, vocabulary, [key]), [key, "token"]).groupBy("scene_no", key).agg(F.array_sort(F.collect_set("token")).alias("matched"))
    usable = clips.groupBy(key).agg(F.count("*").alias("clips"), F.avg("usable_ratio").alias("avg_usable"))
    out = scenes.join(matched, ["scene_no", key], "left").join(votes, key, "left").join(usable, key, "left").join(known, key, "left")
    out = out.fillna(0, ["clips", *[f"__{n}" for n, _ in lists]]).fillna(0.0, ["avg_usable"]).fillna(False, ["content_checked"])
    head = words("heading")
    wants = {w: F.array_contains(head, w) for w in ("int", "ext", "day", "night")}
    lean = F.when(F.col("__outdoor") > F.col("__indoor"), "ext").when(F.col("__indoor") > F.col("__outdoor"), "int")
    tod = F.when(F.col("__night") > F.col("__day"), "night").when(F.col("__day") > F.col("__night"), "day")

    def judge(vote: Column, a: str, b: str) -> Column:
        asked = vote.isNotNull() & (wants[a] | wants[b])
        agrees = ((vote == a) & wants[a]) | ((vote == b) & wants[b])
        return F.when(asked, F.when(agrees, "match").otherwise("mismatch"))

    place, time = judge(lean, "ext", "int"), judge(tod, "night", "day")
    seen = F.coalesce(F.size("matched") > 0, F.lit(False))
    checked = F.col("content_checked")
    out = out.withColumns({"place": F.when(checked, place), "time": F.when(checked, time), "overlap": F.when(checked, seen)})
    score = 0.5 + F.when(F.col("overlap"), 0.25).otherwise(0.0) + F.when(F.col("place") == "match", 0.15).otherwise(0.0) + F.when(F.col("time") == "match", 0.1).otherwise(0.0)
    codes = F.array_compact(F.array(
        F.when(F.col("clips") == 0, F.lit("no_clips")), F.when(~checked, F.lit("no_labels")),
        F.when(F.col("overlap"), F.lit("words_shared")).when(~F.col("overlap"), F.lit("no_words_shared")),
        F.when(F.col("place").isNotNull(), F.concat(F.lit("place_"), lean, F.lit("_"), F.col("place"))),
        F.when(F.col("time").isNotNull(), F.concat(F.lit("time_"), tod, F.lit("_"), F.col("time"))),
    ))
    return out.select(
        "scene_no", key, score.alias("score"), "content_checked", "clips", "avg_usable", "overlap", "place", "time",
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), codes.alias("findings"),
    )


def shoot_plan(scenes: DataFrame, checks: DataFrame, takes: DataFrame) -> DataFrame:
    """Status per scene: unshot, assigned, checked-ok or checked-weak with reasons; thin with exactly one named take.

    ``checks`` are rows of :func:`scene_check`, judged only while they match the assigned folder; ``takes`` has
    (scene_no, folder, takes).
    """
    c = checks.select("scene_no", "folder", F.lit(True).alias("__c"), "clips", "avg_usable", "content_checked", "score", "place", "time")
    out = scenes.join(c, ["scene_no", "folder"], "left").join(takes, ["scene_no", "folder"], "left")
    judged = F.coalesce("__c", F.lit(False))
    some = F.col("clips") > 0
    why = F.array_compact(F.array(
        F.when(judged & ~some, F.lit("no_clips")),
        F.when(judged & some & (F.col("avg_usable") < WEAK_USABLE), F.lit("little_usable")),
        F.when(judged & some & F.col("content_checked") & (F.col("score") < OK_SCORE), F.lit("low_score")),
        F.when(judged & some & (F.col("place") == "mismatch"), F.lit("place")),
        F.when(judged & some & (F.col("time") == "mismatch"), F.lit("time")),
    ))
    shot = F.trim(F.coalesce("folder", F.lit(""))) != ""
    status = F.when(~shot, "unshot").when(~judged, "assigned").when(F.size(why) > 0, "checked-weak").otherwise("checked-ok")
    thin = shot & F.coalesce(F.col("takes") == 1, F.lit(False))
    return out.select(*scenes.columns, status.alias("status"), F.when(shot & judged, why).otherwise(F.array().cast("array<string>")).alias("why"), thin.alias("thin"), "takes")


def shoot_progress(plan: DataFrame, key: str) -> DataFrame:
    n = F.count("*")
    names = [("unshot", "unshot"), ("assigned", "assigned"), ("checked_ok", "checked-ok"), ("checked_weak", "checked-weak")]
    return plan.groupBy(key).agg(
        n.alias("scenes"), *[F.count_if(F.col("status") == s).alias(a) for a, s in names], F.count_if("thin").alias("thin"),
        F.bround(100 * F.count_if(F.col("status") != "unshot") / n).cast("bigint").alias("percent"),
    )


def scene_targets(scenes: DataFrame) -> DataFrame:
    """Screen time, pace and transition of a scene from its dialogue lines, action text and cut intent."""
    count = F.size(F.filter(F.split(F.trim("action"), r"\s+"), lambda w: w != ""))
    raw = SCENE_BASE + SCENE_PER_LINE * F.col("lines") + F.least(F.lit(SCENE_ACTION_MAX), count / SCENE_WORDS)
    t = F.lower(F.coalesce("cut_intent", F.lit("")))
    has = lambda ws: F.greatest(*[F.contains(t, F.lit(w)) for w in ws])
    pace = F.when(has(CALM_WORDS), PACES["calm"]).when(has(FAST_WORDS), PACES["fast"]).otherwise(PACES["default"])
    cut = F.when(has(HARD_WORDS), "cuts").when(has(SOFT_WORDS), "dissolves").otherwise("cuts")
    return scenes.withColumns({
        "target_s": F.least(F.lit(SCENE_MAX), F.greatest(F.lit(SCENE_MIN), raw)), "pace": pace, "transitions": cut,
    })


# -- selection -----------------------------------------------------------------------------------------------------


#: Rows of a project that one step of the walk along pictures looks at.
PICTURES = 256


def apart_pictures(pool: DataFrame, first: DataFrame, k: int, project: str, bits: int) -> DataFrame:
    """Rows (project, mid) that a walk in order of ``place`` takes until a project has ``k`` with those of ``first``: a row is taken unless its
    picture is within ``bits`` of one taken before; hash 0 is like no other.

    Each round drops what is near a taken picture, side by side, and walks the next ``PICTURES`` rows of every project that are left: the
    first of them is always taken, so there are k rounds at most. Rows without a score (``place.a``) are walked first but picked last, so they
    do not count.
    """
    hashed = F.collect_set(F.when(F.col("phash") != 0, F.col("phash")))
    open_ = settle(first.groupBy(project).agg(hashed.alias("__held"), (F.lit(k) - F.count("*")).cast("int").alias("__left")).where("__left > 0").withColumn("__last", F.lit(None).cast(pool.schema["place"].dataType)))
    row = F.struct("place", "mid", "phash")
    row_type = f"array<{pool.select(row.alias('r')).dtypes[0][1]}>"
    taken = pool.select(project, "mid").limit(0)
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    while not open_.isEmpty():
        ahead = pool.join(open_, project).where(F.col("__last").isNull() | (F.col("place") > F.col("__last")))
        ahead = ahead.where((F.col("phash") == 0) | ~F.exists("__held", lambda h: near(h, F.col("phash"))))
        ahead = ahead.withColumn("__r", F.row_number().over(Window.partitionBy(project).orderBy("place"))).where(F.col("__r") <= PICTURES)
        heads = ahead.groupBy(project).agg(F.first("__held").alias("__held"), F.first("__left").alias("__left"), F.array_sort(F.collect_list(row)).cast(row_type).alias("l"))

        def step(chosen: Column, x: Column) -> Column:
            free = F.forall(chosen, lambda o: (o["phash"] == 0) | (x["phash"] == 0) | ~near(o["phash"], x["phash"]))
            more = F.size(F.filter(chosen, lambda o: o["place"]["a"].isNotNull())) < F.col("__left")
            return F.when(more & free, F.concat(chosen, F.array(x))).otherwise(chosen)

        walked = settle(heads.withColumn("t", F.aggregate("l", F.array().cast(row_type), step)).select(project, "__held", "__left", "t", F.size("l").alias("__n"), F.element_at("l", -1)["place"].alias("__last")))
        taken = taken.unionByName(walked.select(project, F.explode("t.mid").alias("mid")))
        held = F.concat("__held", F.transform(F.filter("t", lambda o: o["phash"] != 0), lambda o: o["phash"]))
        left = F.col("__left") - F.size(F.filter("t", lambda o: o["place"]["a"].isNotNull()))
        open_ = settle(walked.where(F.col("__n") == PICTURES).select(project, held.alias("__held"), left.alias("__left"), "__last").where("__left > 0"))
    return taken.distinct()


def select_moments(moments: DataFrame, k: int, project: str = "project", bits: int = DEDUP_BITS) -> DataFrame:
    """Best moment of every clip first, then by score without near duplicates of a chosen picture; at most ``k``.

    Exact copies of a picture stand behind the first of them, so they are dropped before the walk (:func:`apart_pictures`).
    """
    pos = F.struct((-F.col("score")).alias("a"), F.col("start_s").alias("b"), F.col("mid").alias("c"))
    per_clip = moments.groupBy(project, "clip_path").agg(F.min(pos).alias("p")).select(project, F.col("p.c").alias("mid"))
    marked = moments.join(per_clip.withColumn("__b", F.lit(True)), [project, "mid"], "left")
    best = marked.where("__b")
    order = [F.desc("score"), F.asc("clip_path"), F.asc("start_s"), F.asc("mid")]
    first = best.withColumn("pick", F.row_number().over(Window.partitionBy(project).orderBy(*order))).where(F.col("pick") <= k)
    first = settle(first.select(project, F.col("pick").cast("bigint").alias("pick"), "mid", "phash"))
    rest = marked.where(F.col("__b").isNull())
    place = F.struct((-F.col("score")).alias("a"), F.col("clip_path").alias("b"), F.col("start_s").alias("c"), F.col("mid").alias("d"))
    heads = rest.where(F.col("phash") != 0).groupBy(project, "phash").agg(F.min(place).alias("p")).select(project, F.col("p.d").alias("mid"))
    pool = rest.where(F.col("phash") == 0).select(project, "mid").unionByName(heads)
    pool = settle(rest.join(pool, [project, "mid"], "left_semi"))
    taken = apart_pictures(pool.select(project, "mid", "phash", place.alias("place")), first, k, project, bits)
    have = first.groupBy(project).agg(F.count("*").alias("__have"))
    nth = F.row_number().over(Window.partitionBy(project).orderBy(*order))
    more = pool.join(taken, [project, "mid"], "left_semi").join(have, project).withColumn("pick", nth).where(F.col("pick") <= k)
    more = more.withColumn("pick", (F.col("pick") + F.col("__have")).cast("bigint")).where(F.col("pick") <= k)
    cols = [project, "pick", "mid", "phash"]
    return first.select(*cols).unionByName(more.select(*cols))


def strength() -> Column:
    return F.col("score") + SEED_HERO * F.col("hero") + SEED_HIGHLIGHT * F.col("highlight")


def series_seeds(moments: DataFrame, n: int, project: str = "project") -> DataFrame:
    """Strong, well separated moments: one per clip, then more of the same clips at least eight seconds apart."""
    s = F.round(strength(), 9)
    order = [s.desc(), F.asc("clip_path"), F.asc("start_s"), F.asc("end_s"), F.asc("mid")]
    pos = F.struct((-s).alias("a"), F.col("start_s").alias("b"), F.col("end_s").alias("c"), F.col("mid").alias("d"))
    lead = moments.groupBy(project, "clip_path").agg(F.min(pos).alias("p")).select(project, F.col("p.d").alias("mid"))
    firsts = moments.join(lead, [project, "mid"]).withColumn("pick", F.row_number().over(Window.partitionBy(project).orderBy(*order))).where(F.col("pick") <= n)
    cols = ["mid", "clip_path", "start_s", "end_s", "daylight", "shot_size", "grp", "score"]
    firsts = settle(firsts.select(project, F.col("pick").cast("bigint").alias("pick"), *cols))
    short = firsts.groupBy(project).agg(
        F.count("*").alias("__n"), F.collect_set(F.nullif("daylight", F.lit(""))).alias("__day"), F.collect_set(F.nullif("shot_size", F.lit(""))).alias("__size")
    ).where(F.col("__n") < n)
    rest = moments.join(short, project).join(firsts.select(project, "mid"), [project, "mid"], "left_anti")
    novelty = F.array_contains("__day", F.col("daylight")).cast("int") + F.array_contains("__size", F.col("shot_size")).cast("int")
    rest = rest.withColumn("__seen", novelty.cast("bigint"))
    # Only moments of one clip stand in each other's way, its seed before all others.
    look = F.struct(F.col("__seen").alias("n"), (-s).alias("a"), F.col("start_s").alias("b"), F.col("end_s").alias("c"), F.col("mid").alias("d"))
    near = SEED_GAP - EPS
    span = (F.col("start_s") - near, F.col("start_s") + near)
    given = firsts.select(project, "clip_path", span[0].alias("c0"), span[1].alias("c1"))
    apart = spaced_picks(rest, [project, "clip_path"], F.col("start_s"), span, look, 2 * near, n, "mid", given).select(project, "mid")
    nth = F.row_number().over(Window.partitionBy(project).orderBy(F.asc("__seen"), *order))
    more = rest.join(apart, [project, "mid"], "left_semi").withColumn("pick", nth).where(F.col("pick") <= n)
    more = more.withColumn("pick", (F.col("pick") + F.col("__n")).cast("bigint")).where(F.col("pick") <= n)
    return firsts.select(project, "pick", *cols).unionByName(more.select(project, "pick", *cols))


def partition_moments(moments: DataFrame, seeds: DataFrame, project: str = "project") -> DataFrame:
    """Home of every moment: the closest seed in time on its own clip, else the most alike; ties to the earlier seed.

    A series has a handful of seeds; they travel as one array per project.
    """
    look = F.struct("pick", "clip_path", "start_s", "daylight", "shot_size", "grp", *(["tags"] if "tags" in seeds.columns else []))
    packed = seeds.groupBy(project).agg(F.array_sort(F.collect_list(look)).alias("__s"))
    differs = lambda s, c: F.when((F.col(c) != "") & (s[c] != "") & (F.col(c) != s[c]), LOOK[c]).otherwise(0.0)

    def apart(s: Column) -> Column:
        other = LOOK["base"] + differs(s, "daylight") + differs(s, "shot_size") + differs(s, "grp")
        if "tags" in seeds.columns and "tags" in moments.columns:
            other = other - LOOK["tag"] * F.size(F.array_intersect(F.col("tags"), s["tags"]))
        return F.when(F.col("clip_path") == s["clip_path"], F.abs(F.col("start_s") - s["start_s"])).otherwise(CROSS_CLIP + F.greatest(F.lit(0.0), other))

    home = F.array_min(F.transform("__s", lambda s: F.struct(F.round(apart(s), 6).alias("d"), s["pick"].alias("pick"))))
    return moments.join(packed, project).withColumn("seed", home["pick"]).withColumn("distance", home["d"]).drop("__s")


# -- preferences and pools ---------------------------------------------------------------------------------------------


def preference_counts(signals: DataFrame, user: list[str] = []) -> DataFrame:
    """Counts per family, context and direction with the last time seen; listed active first, then by count."""
    context = F.when(F.trim(F.coalesce("context", F.lit(""))) == "", "*").otherwise(F.trim("context"))
    rows = signals.where((F.trim("family") != "") & (F.trim("direction") != ""))
    out = rows.groupBy(*user, F.trim("family").alias("family"), context.alias("context"), F.trim("direction").alias("direction")).agg(
        F.count("*").alias("count"), F.max("at").alias("last")
    )
    return out.withColumn("active", F.col("count") >= ACTIVE_FROM)


def casting_bias(counts: DataFrame, user: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(size weights per phase, one row of pace notches and dissolve habit) from the active signals."""
    live = counts.where("active")
    sign = F.when(F.col("family") == "shot_size", SIZE_WEIGHT).when(F.col("family") == "avoid_shot_size", -SIZE_WEIGHT)
    sizes = live.where(sign.isNotNull() & F.col("direction").isin(*SHOT_SIZES)).groupBy(*user, F.col("context").alias("phase"), F.col("direction").alias("shot_size")).agg(F.sum(sign).alias("weight"))
    pace = F.when(F.col("direction") == "shorter", -1).when(F.col("direction") == "longer", 1).otherwise(0)
    length = F.sum(F.when(F.col("family") == "shot_length", pace).otherwise(0))
    habits = (live.groupBy(*user) if user else live).agg(
        F.greatest(F.lit(-1), F.least(F.lit(1), F.coalesce(length, F.lit(0)))).cast("bigint").alias("pace_notches"),
        F.coalesce(F.max((F.col("family") == "transition") & (F.col("direction") == "cut")), F.lit(False)).alias("fewer_dissolves"),
    )
    return sizes, habits


def pool_stats(projects: DataFrame, media: DataFrame, reports: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pool size by kind, freshly analysed clips and whether a plan exists, per project.

    ``media`` (project, path, kind), ``reports`` (project, path, mtime), ``inventory`` (path, mtime).
    """
    pool = media.dropDuplicates(["project", "path"]).groupBy("project").agg(
        F.count("*").alias("pool_size"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders")
    )
    fresh = reports.join(inventory, ["path", "mtime"], "left_semi").dropDuplicates(["project", "path"]).groupBy("project").agg(F.count("*").alias("analysed"))
    out = projects.join(pool, "project", "left").join(fresh, "project", "left")
    return out.fillna(0, ["pool_size", "files", "folders", "analysed"])
