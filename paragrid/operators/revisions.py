"""Tracked revisions as arrays of typed segments: views, folding of no-op pairs, clusters, segment rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.rules import ARTICLES, FORBIDDEN_COLLOCATIONS, TRANSPARENT_MARKS, VIEW_RULES
from paragrid.functions.text import is_bracket_only, is_noise, is_wordlike, normalized, orthographic_key

#: How many segments away a revision's content keeps a bracket.
NEAR = 8
KEPT = {"accept": ["regular", "ins"], "reject": ["regular", "del"]}


def view(segments: Column, mode: str, text: str = "en") -> Column:
    """The text with all revisions accepted or rejected; what is inserted and then deleted is in neither."""
    kept = F.filter(segments, lambda s: s["type"].isin(KEPT[mode]))
    return F.array_join(F.transform(kept, lambda s: F.coalesce(s[text], F.lit(""))), "")


def segments_of(rows: DataFrame, kind: Column, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, segments: the ordered segments of each document."""
    struct = F.struct(F.col(order).alias("o"), kind.alias("type"), F.col(text).alias("en"))
    ordered = F.array_sort(F.collect_list(struct))
    return rows.groupBy(doc).agg(F.transform(ordered, lambda s: F.struct(s["type"].alias("type"), s["en"].alias("en"))).alias("segments"))


def view_findings(docs: DataFrame, collocations: list[str] | None = None, key: str = "doc_id", segments: str = "segments") -> DataFrame:
    """key, view, rule, n: rules and forbidden word sequences found in either view."""
    banned = FORBIDDEN_COLLOCATIONS + (collocations or [])
    views = F.array(*[F.struct(F.lit(m).alias("view"), view(F.col(segments), m).alias("text")) for m in KEPT])
    each = docs.select(key, F.inline(views))
    counts = [F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p in VIEW_RULES]
    counts += [F.struct(F.lit(f"collocation: {c}").alias("rule"), ((F.length("text") - F.length(F.replace(F.lower("text"), F.lit(c), F.lit("")))) / len(c)).cast("int").alias("n")) for c in banned]
    return each.select(key, "view", F.inline_outer(F.filter(F.array(*counts), lambda c: c["n"] > 0))).where("rule is not null")


def _merged(segments: Column, text: str = "text") -> Column:
    """Neighbours of one type as one segment, with a fold over the array."""
    kind = f"array<struct<type:string,{text}:string>>"

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        piece = F.coalesce(s[text], F.lit(""))
        same = last["type"].eqNullSafe(s["type"]) & (F.size(done) > 0)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["type"].alias("type"), F.concat(last[text], piece).alias(text))))
        return F.when(same, joined).otherwise(F.concat(done, F.array(F.struct(s["type"].alias("type"), piece.alias(text)))))

    return F.aggregate(segments, F.array().cast(kind), step)


def merged(segments: Column, text: str = "text") -> Column:
    return _merged(segments, text)


def fold_pairs(segments: Column, key=normalized, text: str = "text") -> Column:
    """Insertions and deletions of the same text side by side become one regular segment; the fold sees pairs that this exposes.

    Marks (TRANSPARENT_MARKS as types) between the two don't part them, and stay; any other segment does. A pair without text goes."""
    piece = f"struct<type:string,{text}:string>"
    item = f"struct<before:array<{piece}>,type:string,{text}:string>"
    plain = F.transform(segments, lambda s: F.struct(s["type"].alias("type"), s[text].alias(text)))
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.array().cast(f"array<{piece}>").alias("marks"))

    def step(state: Column, s: Column) -> Column:
        done, marks = state["done"], state["marks"]
        last, rest = F.try_element_at(done, F.lit(-1)), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        opposite = ((last["type"] == "ins") & (s["type"] == "del")) | ((last["type"] == "del") & (s["type"] == "ins"))
        same = F.coalesce(opposite & (key(F.coalesce(last[text], F.lit(""))) == key(F.coalesce(s[text], F.lit("")))), F.lit(False))
        inserted = F.when(s["type"] == "ins", s[text]).otherwise(last[text])
        around = F.concat(last["before"], marks)
        with_item = lambda items, before, kind, t: F.concat(items, F.array(F.struct(before.alias("before"), kind.alias("type"), t.alias(text))))
        none = F.array().cast(f"array<{piece}>")
        to = lambda items, left: F.struct(items.alias("done"), left.alias("marks"))
        folded = (
            F.when(F.coalesce(inserted, F.lit("")) == "", to(rest, around))
            .when(s["type"] == "ins", to(with_item(rest, around, F.lit("regular"), inserted), none))
            .otherwise(to(with_item(rest, last["before"], F.lit("regular"), inserted), marks))
        )
        return F.when(s["type"].isin(TRANSPARENT_MARKS), to(done, F.concat(marks, F.array(s)))).when(same, folded).otherwise(to(with_item(done, marks, s["type"], s[text]), none))

    finish = lambda state: F.concat(F.flatten(F.transform(state["done"], lambda i: F.concat(i["before"], F.array(F.struct(i["type"].alias("type"), i[text].alias(text)))))), state["marks"])
    return F.aggregate(plain, start, step, finish)


def drop_noise(segments: Column, text: str = "text") -> Column:
    """Segments without revisions that hold no letter, digit or sign of value. Brackets stay where one of the NEAR segments on either
    side is a revision with letters or digits; on the left only what is still there counts, on the right all."""
    revised = lambda s: s["type"].isin("ins", "del", "ins_then_del")
    content = lambda s: revised(s) & F.coalesce(s[text], F.lit("")).rlike(r"[\p{L}\p{N}]")
    plain = F.transform(segments, lambda s: F.struct(s["type"].alias("type"), s[text].alias(text)))
    with_next = F.transform(plain, lambda s, i: F.struct(s.alias("s"), F.slice(plain, i + 2, NEAR).alias("next")))

    def step(kept: Column, x: Column) -> Column:
        s = x["s"]
        before = F.slice(kept, F.greatest(F.size(kept) - NEAR + 1, F.lit(1)), NEAR)
        near = F.exists(before, content) | F.exists(x["next"], content)
        gone = revised(s) & is_noise(s[text]) & ~(F.coalesce(is_bracket_only(s[text]), F.lit(False)) & near)
        return F.when(gone, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(with_next, F.array().cast(f"array<struct<type:string,{text}:string>>"), step)


def strip_noops(segments: Column, text: str = "text", keep_phantoms: bool = False) -> Column:
    """Equal pairs, then revisions without content, pairs that this exposes, and what is inserted and then deleted."""
    again = fold_pairs(F.transform(F.array(fold_pairs(segments, text=text)), lambda once: drop_noise(once, text))[0], text=text)
    return again if keep_phantoms else F.filter(again, lambda s: s["type"] != "ins_then_del")


def absorb_blanks(segments: Column, text: str = "text") -> Column:
    """Revisions of white space only go into the nearest regular segment before them, at its end, or else behind them, at its start;
    where there is none, or with a zero-width blank in them, they stay."""
    plain = F.transform(segments, lambda s, i: F.struct(s["type"].alias("type"), s[text].alias(text), i.alias("i")))
    blank = lambda s: s["type"].isin("ins", "del") & (F.coalesce(s[text], F.lit("")) != "") & ~F.coalesce(s[text], F.lit("")).rlike("(?U)\\S") & ~F.coalesce(s[text], F.lit("")).contains("\u200b")
    regular = F.transform(F.filter(plain, lambda s: s["type"] == "regular"), lambda s: s["i"])
    blanks = F.filter(plain, blank)
    first = F.try_element_at(regular, F.lit(1))
    home = lambda s: F.coalesce(F.array_max(F.filter(regular, lambda r: r < s["i"])), first)

    def one(s: Column) -> Column:
        mine = F.filter(blanks, lambda b: home(b) == s["i"])
        before = F.array_join(F.reverse(F.transform(F.filter(mine, lambda b: b["i"] < s["i"]), lambda b: b[text])), "")
        behind = F.array_join(F.transform(F.filter(mine, lambda b: b["i"] > s["i"]), lambda b: b[text]), "")
        t = F.when(s["type"] == "regular", F.concat(before, F.coalesce(s[text], F.lit("")), behind)).otherwise(s[text])
        return F.struct(s["type"].alias("type"), t.alias(text))

    return F.transform(F.filter(plain, lambda s: ~blank(s) | first.isNull()), one)


def _runs_of_pieces(segments: Column, text: str) -> Column:
    """Neighbouring segments without white space, of at most 60 characters, as one run; any other segment as a run of its own."""
    piece = f"struct<type:string,{text}:string>"
    small = lambda s: ~F.coalesce(s[text], F.lit("")).rlike(r"(?U)\s") & (F.length(F.coalesce(s[text], F.lit(""))) <= 60) & ~s["type"].isin(TRANSPARENT_MARKS)

    def step(runs: Column, s: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        one = F.array(F.struct(s["type"].alias("type"), s[text].alias(text)))
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(F.lit(True).alias("small"), F.concat(last["s"], one).alias("s"))))
        return F.when(F.coalesce(last["small"], F.lit(False)) & small(s), grown).otherwise(F.concat(runs, F.array(F.struct(small(s).alias("small"), one.alias("s")))))

    return F.aggregate(segments, F.array().cast(f"array<struct<small:boolean,s:array<{piece}>>>"), step)


def _side(run: Column, left_out: str, text: str) -> Column:
    return F.array_join(F.transform(F.filter(run, lambda s: s["type"] != left_out), lambda s: F.coalesce(s[text], F.lit(""))), "")


def _is_cluster(run: Column, least: int, text: str) -> Column:
    n = lambda kind: F.size(F.filter(run["s"], lambda s: s["type"] == kind))
    accepted, rejected = _side(run["s"], "del", text), _side(run["s"], "ins", text)
    return run["small"] & (F.size(run["s"]) >= 2) & (n("ins") + n("del") >= least) & (n("ins") >= 1) & (n("del") >= 1) & is_wordlike(accepted) & is_wordlike(rejected) & (accepted != rejected)


def clusters(segments: Column, least: int = 3, text: str = "text") -> Column:
    """first, last, inserted, deleted: runs of small pieces that spell one changed word, by their places from 0."""
    at = F.transform(_runs_of_pieces(segments, text), lambda r: F.struct(r.alias("run"), F.size(r["s"]).alias("n")))
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<first:int,last:int,inserted:string,deleted:string>>").alias("out"))
    found = lambda state, x: F.array(F.struct(state["i"].alias("first"), (state["i"] + x["n"] - 1).alias("last"), _side(x["run"]["s"], "del", text).alias("inserted"), _side(x["run"]["s"], "ins", text).alias("deleted")))
    step = lambda state, x: F.struct((state["i"] + x["n"]).alias("i"), F.when(_is_cluster(x["run"], least, text), F.concat(state["out"], found(state, x))).otherwise(state["out"]).alias("out"))
    return F.aggregate(at, start, step, lambda state: state["out"])


def coalesced(segments: Column, least: int = 3, text: str = "text") -> Column:
    """Each cluster as one insertion and one deletion of the whole word: fewer pieces, and both views as before."""
    kept = lambda run, kinds: F.array_join(F.transform(F.filter(run["s"], lambda s: s["type"].isin(kinds)), lambda s: F.coalesce(s[text], F.lit(""))), "")
    word = lambda run, kind, mode: F.struct(F.lit(kind).alias("type"), kept(run, KEPT[mode]).alias(text))
    return F.flatten(F.transform(_runs_of_pieces(segments, text), lambda r: F.when(_is_cluster(r, least, text), F.array(word(r, "ins", "accept"), word(r, "del", "reject"))).otherwise(r["s"])))


def cluster_skeleton(segments: Column, least: int = 3, text: str = "text", inserted: str | None = None, deleted: str | None = None) -> Column:
    """As many target segments as the source has, all empty but for the first insertion and the first deletion of each cluster, which say
    what to translate. With one cluster only, ``inserted`` and ``deleted`` are set in directly, if both are given. Null without clusters."""
    found = clusters(segments, least, text)

    def one(s: Column, i: Column, here: Column) -> Column:
        mine = F.try_element_at(F.filter(here, lambda c: (c["first"] <= i) & (i <= c["last"])), F.lit(1))
        first = ~F.exists(F.slice(segments, mine["first"] + 1, F.greatest(i - mine["first"], F.lit(0))), lambda b: b["type"] == s["type"])
        ask = lambda kind, word, direct, state: F.when(F.lit(inserted is not None and deleted is not None) & (F.size(here) == 1), F.lit(direct)).otherwise(F.concat(F.lit(f"<<TRANSLATE: {kind}='"), mine[word], F.lit(f"' ({state})>>")))
        en = F.when(F.coalesce(first, F.lit(False)) & (s["type"] == "ins"), ask("ins", "inserted", inserted, "accepted")).when(F.coalesce(first, F.lit(False)) & (s["type"] == "del"), ask("del", "deleted", deleted, "rejected")).otherwise("")
        return F.struct(s["type"].alias("type"), en.alias("en"))

    made = F.transform(F.array(found), lambda here: F.when(F.size(here) > 0, F.transform(segments, lambda s, i: one(s, i, here))))[0]
    return made


def same_kind_runs(segments: Column) -> Column:
    """type, count: runs of two or more insertions or deletions side by side, in order."""
    start = F.array().cast("array<struct<type:string,count:int>>")

    def step(runs: Column, s: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["type"].alias("type"), (last["count"] + 1).alias("count"))))
        return F.when(last["type"].eqNullSafe(s["type"]) & (F.size(runs) > 0), grown).otherwise(F.concat(runs, F.array(F.struct(s["type"].alias("type"), F.lit(1).alias("count")))))

    return F.filter(F.aggregate(segments, start, step), lambda r: r["type"].isin("ins", "del") & (r["count"] >= 2))


def guarded(text: Column) -> Column:
    """A zero-width blank between neighbouring letters among the first four characters."""
    letter = lambda k: F.substring(text, k, 1).rlike(r"^\p{L}$")
    joint = lambda k: F.when((F.length(text) > k) & letter(k) & letter(k + 1), "\u200b").otherwise("")
    return F.concat(F.substring(text, 1, 1), joint(1), F.substring(text, 2, 1), joint(2), F.substring(text, 3, 1), joint(3), F.substring(text, 4, 2**31 - 1))


def guard_clusters(records: DataFrame, segments: str = "en_segments", hits: str = "tc_cluster_hits") -> DataFrame:
    """records with the translations of segments guarded whose kind stands in several pieces side by side, and changed, how many did."""
    kinds = F.transform(F.coalesce(hits, F.array().cast("array<struct<type:string,count:int>>")), lambda h: h["type"])
    mine = lambda s: F.coalesce(F.array_contains(kinds, s["type"]) & (F.trim(s["en"]) != ""), F.lit(False))
    made = F.transform(segments, lambda s: F.struct(s["type"].alias("type"), F.when(mine(s), guarded(s["en"])).otherwise(s["en"]).alias("en")))
    changed = F.coalesce(F.size(F.filter(segments, lambda s: mine(s) & (guarded(s["en"]) != s["en"]))), F.lit(0))
    return records.withColumns({"changed": changed, segments: made})


def fold_orthographic(segments: Column, text: str = "text") -> Column:
    return fold_pairs(segments, orthographic_key, text)


def fragment_clusters(rows: DataFrame, least: int = 3, doc: str = "doc_id", order: str = "idx", text: str = "text", kind: str = "type") -> DataFrame:
    """doc, first, last, n, inserted, deleted: runs of small revision pieces that spell a changed word on either side."""
    at = Window.partitionBy(doc).orderBy(order)
    small = F.col(kind).isin("ins", "del") & ~F.col(text).rlike(r"(?U)\s") & (F.length(text) <= 60)
    piece = (small | ((F.col(kind) == "regular") & ~F.col(text).rlike(r"(?U)\s") & (F.length(text) <= 60))).cast("int")
    numbered = rows.withColumn("piece", piece).withColumn("run", F.sum(F.when(F.col("piece") != F.coalesce(F.lag("piece").over(at), F.lit(-1)), 1).otherwise(0)).over(at)).where("piece = 1")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("type"), F.col(text).alias("en"))))
    runs = numbered.groupBy(doc, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum(F.col(kind).isin("ins", "del").cast("int")).alias("n"), F.countDistinct(F.when(F.col(kind).isin("ins", "del"), F.col(kind))).alias("kinds"), ordered.alias("s"))
    shown = runs.withColumns({"inserted": view(F.col("s"), "accept"), "deleted": view(F.col("s"), "reject")})
    return shown.where((F.col("n") >= least) & (F.col("kinds") == 2) & is_wordlike(F.col("inserted")) & is_wordlike(F.col("deleted")) & (F.col("inserted") != F.col("deleted"))).select(doc, "first", "last", "n", "inserted", "deleted")


def segment_findings(rows: DataFrame, doc: str = "doc_id", order: str = "idx", text: str = "text", kind: str = "type") -> DataFrame:
    """doc, order, rule: rules on single segments and on neighbours of which one is a revision."""
    at = Window.partitionBy(doc).orderBy(order)
    articles = "|".join(ARTICLES)
    t, before, type_before = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.lag(text).over(at), F.lit("")), F.lag(kind).over(at)
    made = rows.withColumns({"t": t, "b": before, "bk": type_before})
    t, b, revised = F.col("t"), F.col("b"), F.col(kind) != "regular"
    pair = F.col("bk").isNotNull() & (revised | (F.col("bk") != "regular")) & (b != "") & (t != "")
    mixed = pair & (revised != (F.col("bk") != "regular"))
    rules = {
        "article_collision": pair & (F.col("bk") == "regular") & revised & b.rlike(rf"(?iU)\b(?:{articles})\s*$") & t.rlike(rf"(?iU)^\s*(?:{articles})\b"),
        "alpha_collision": pair & b.rlike(r"\p{L}\z") & t.rlike(r"^\p{L}"),
        "digit_at_boundary": mixed & ((b.rlike(r"\d$") & t.rlike(r"^\p{L}")) | (b.rlike(r"\p{L}$") & t.rlike(r"^\d"))),
        "double_space": pair & b.endswith(" ") & t.startswith(" "),
        "bare_article": revised & F.lower(F.trim("t")).isin(ARTICLES),
        "double_article": t.rlike(rf"(?iU)\b(?:{articles})\s+(?:{articles})\b"),
        "camel_collision": t.rlike("[a-z][A-Z]"),
        "word_then_digit": t.rlike("[a-z]{2,}[0-9]"),
        "digit_then_word": t.rlike("[0-9][a-z]{3,}"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("hit")) for n, c in rules.items()])
    return made.select(doc, order, F.inline_outer(F.filter(each, lambda r: r["hit"]))).where("rule is not null").drop("hit")
