"""Texts cut off by field limits or broken transfers.

Evidence, weighed against what is usual for the source: a copy of the same
message that goes on, a length at the source's field limit, a mark put behind a
cut at that limit, and a structure that is not complete at the end: a stack
automaton finds unclosed quotes and brackets; broken escapes, links and
characters, torn words and words no sentence ends with are found at the tail.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.runtime import materialize

#: Marks that systems put behind a cut.
MARKS = ("…", "...", "[...]", "[…]", "(...)", "(…)", "(more)", "[more]", "(cont)", "(cont.)", "[cut]")
NEAR = 15  #: a cut moved back to a word end loses fewer characters than this
RULES_UP_TO = 200_000  #: learned rules up to which their table is broadcast
LONGEST_WORD = 64  #: what is longer is no word: neither known nor torn
FLUSH = 300_000
CLOSERS = {"”": "“", ")": "(", "]": "[", "}": "{", "»": "«", "」": "「", "』": "『"}
STOPS = ".!?。！？…”»」』)]"

LINK = re.compile(r"https?://[^ \t\r\n]*")
TAIL = re.compile(r"\s?(" + "|".join(map(re.escape, sorted(MARKS, key=len, reverse=True))) + r")(\s+https?://\S+)?$")
#: Quotes and brackets, and markup: code fences and ticks, bold, tags and comments, also those that do not end.
STRUCTURE = re.compile(r"```|`|\*\*|<!--|-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<[/A-Za-z][^<>]*$|[\"" + re.escape("".join([*CLOSERS, *CLOSERS.values()])) + "]")
#: Tags that enclose nothing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words with digits as 0, hashtags, single characters of scripts without blanks, single signs; a link or line end is the sign |.
TOKEN = re.compile(r"#\w+|[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|(?:(?![\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff_])\w)+|[^\w\s]|_")
DIGITS, LINES = re.compile(r"\d+"), re.compile(r"[\r\n]+")
BROKEN = re.compile(r"(?:\ufffd|&(?:#x?[0-9a-fA-F]{0,7}|[a-z0-9]{0,6})|\\u?[0-9a-fA-F]{0,3}|\\u[dD][89abAB][0-9a-fA-F]{2})$")
ESCAPED = re.compile(r"((?:%[0-9A-Fa-f]{2})+)(%[0-9A-Fa-f]?)?$")
LAST_LINK = re.compile(r"https?:\S*$")
LAST_TAG = re.compile(r"#\w+$")


def tokens(text: str) -> list[str]:
    text = LINES.sub(" | ", LINK.sub(" | ", text)) if "http" in text or "\n" in text or "\r" in text else text
    return TOKEN.findall(DIGITS.sub("0", text.lower()))


def unclosed(text: str) -> str:
    """What is open at the end, by a stack automaton: "markup" for a tag, comment,
    code or bold mark, "quote" for a quote or bracket only, "" for nothing.

    A closer without its opener belongs to a smiley or a list and changes
    nothing; a straight quote after a digit, with none open, is a unit. Within
    code only its own mark counts.
    """
    stack: list[str] = []
    for m in STRUCTURE.finditer(text):
        c = m[0]
        if stack and stack[-1] in ("`", "```", "<!--"):
            if c == {"<!--": "-->"}.get(stack[-1], stack[-1]):
                stack.pop()
        elif c in ("`", "```", "**", '"'):
            if c in stack:
                del stack[stack.index(c) :]
            elif c != '"' or not text[m.start() - 1 : m.start()].isdigit():
                stack.append(c)
        elif c in CLOSERS:
            if stack and stack[-1] == CLOSERS[c]:
                stack.pop()
        elif c[0] == "<":
            name = c.strip("</>").split(None, 1)[0].lower() if c.strip("</>") else ""
            if not c.endswith(">") or c == "<!--":
                stack.append(c if c == "<!--" else "<")
            elif c[1] == "/":
                if "<" + name in stack:
                    del stack[stack.index("<" + name) :]
            elif not c.endswith("/>") and name not in VOID:
                stack.append("<" + name)
        elif c != "-->":
            stack.append(c)
    return "" if not stack else "markup" if any(c[0] in "<`*" for c in stack) else "quote"


def torn_escape(text: str) -> bool:
    """Whether the text ends within a percent-encoded character."""
    m = ESCAPED.search(text)
    if not m:
        return False
    try:
        bytes.fromhex(m[1].replace("%", "")).decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data"
    return bool(m[2])


def tag_at_end(text: str) -> bool:
    return "#" in text and bool(LAST_TAG.search(text))


FEATURES = "key {kind}, source string, copy boolean, chars int, octets int, raw_chars int, raw_octets int, wide boolean, form string, kept int, blank boolean, unclosed boolean, markup boolean, lone boolean, broken boolean, stopped boolean, tag boolean, link int, before string, last string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, source, text, copy`` in; what the end of each text looks like out."""
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            r = text.rstrip()
            form, kept = "", len(r)
            if ("…" in r or "..." in r or "]" in r or ")" in r) and (m := TAIL.search(r)):
                form, kept = m[1] + ("+" if m[2] else ""), m.start()
            octets, raw = len(r.replace("\ufffd", "?").encode()), len(text.replace("\ufffd", "?").encode())
            state = unclosed(r) if STRUCTURE.search(r) else ""
            open_ = bool(state)
            # Opened by the first character and never closed: not the work of reordered words.
            lone = open_ and STRUCTURE.findall(r) == [r[0]] and not tag_at_end(r)
            link = LAST_LINK.search(r) if "http" in r else None
            end = r[-1:]
            stop = not open_ and bool(end) and (end in STOPS or end == "\ufe0f" or unicodedata.category(end) in ("So", "Sk"))
            tail = tokens(" ".join(r.rsplit(None, 2)[-2:])) if end and not stop and not link else []
            last = tail[-1] if tail and (tail[-1][-1].isalnum() or tail[-1][0] == "#") and len(tail[-1]) <= LONGEST_WORD else None
            before = tail[-2] if last and len(tail) > 1 else None
            if before == "@":  # names are no words
                last = before = None
            tag = tag_at_end(r)
            rows.append((len(r), octets, len(text), raw, octets > len(r), form, kept, len(text) > len(r), open_, state == "markup", lone, bool(BROKEN.search(r)) or torn_escape(r), stop, tag, len(link[0]) if link else 0, before, last))
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        if rows:
            out = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *out], names=names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in; counts of two tokens that follow each other out, and of link lengths under the sign |."""

    def take(found: Counter) -> pa.RecordBatch:
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(found.values()), pa.int64())], names=["a", "b", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = tokens(text)
            found.update(zip(own, own[1:]))
            if "http" in text:
                found.update(("|link", str(len(x))) for x in LINK.findall(text))
        if len(found) > FLUSH:
            yield take(found)
            found = Counter()
    if found:
        yield take(found)


def _baseline(group: pd.DataFrame) -> pd.DataFrame:
    """Rules of one source, from its counts of lengths: where its field ends and how it cuts there."""
    source = group["source"].iloc[0]
    of = {c: g.groupby("at")["n"].sum().sort_index() for c, g in group.groupby("count")}
    n, none = of["chars"].sum(), pd.Series(dtype="int64")
    out: list[tuple] = []

    def robust_max(per: pd.Series) -> tuple[int, int]:
        beyond = per[::-1].cumsum()[::-1]
        most = beyond > max(1, n * 0.0005)
        top = int(per.index[most].max()) if most.any() else int(per.index.max())
        return top, int(per[(per.index > top - NEAR) & (per.index <= top)].sum())

    chars, near_chars = robust_max(of["chars"])
    octets, near_octets = robust_max(of["octets"])
    wide = of.get("wide", none)
    by_octets = octets <= chars + 1 and wide[wide.index > octets - NEAR].sum() > 0
    limit, near, unit = (octets, near_octets, "octets") if by_octets else (chars, near_chars, "chars")
    if near >= max(20, 0.005 * n):
        plain = of.get(f"plain_{unit}", none)
        before = sum(int(plain.get(limit - i, 0)) for i in range(4, 14)) / 10
        marked = 0
        for form, rows in group[group["count"] == "kept"].groupby("form"):
            kept = rows.groupby("at")["n"].sum().sort_index()
            top = int(kept.index[kept[::-1].cumsum()[::-1] > max(1, kept.sum() * 0.001)].max()) if kept.sum() > 1 else 0
            close = rows[(rows["at"] > top - NEAR) & (rows["at"] <= top)]
            if close["n"].sum() >= max(5, 0.001 * n) and close["longest"].max() >= 0.85 * limit:
                marked += int(close["n"].sum())
                # A mark seen hardly anywhere else is no author's: a longer word may have been dropped before it.
                low = top - NEAR * (2 if close["n"].sum() >= 0.9 * kept.sum() else 1) + 1
                out += [(source, "kept", form, at) for at in range(max(0, low), int(kept.index.max()) + 1)]
        # A source that marks its cuts leaves no unmarked ones: what fills its field exactly is whole.
        if plain.get(limit, 0) >= 3 * max(before, 1) and plain.get(limit, 0) > marked:
            out.append((source, unit, "", limit))
    return pd.DataFrame(out, columns=["source", "unit", "form", "at"])


def _rules(rows: DataFrame) -> DataFrame:
    """``source, unit, form, at``: what lengths are cuts; under the null source those of any source.

    A source's counts, at most a few per length, are what one task gets.
    """
    plain = F.col("form") == ""
    when = {"chars": ("chars", None), "octets": ("octets", None), "wide": ("octets", F.col("wide")), "plain_chars": ("chars", plain), "plain_octets": ("octets", plain), "kept": ("kept", ~plain)}
    each = [F.struct(F.lit(c).alias("count"), (F.col(at) if cond is None else F.when(cond, F.col(at))).alias("at"), F.when(F.lit(c == "kept"), F.col("form")).otherwise("").alias("form")) for c, (at, cond) in when.items()]
    counts = rows.where("chars > 0 AND source IS NOT NULL").select("source", "chars", F.inline(F.array(*each))).where("at IS NOT NULL").groupBy("source", "count", "form", "at").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("longest"))
    own = materialize(counts.groupBy("source").applyInPandas(_baseline, "source string, unit string, form string, at int"))
    return own.unionByName(own.select(F.lit(None).cast("string").alias("source"), "unit", "form", "at").distinct())


def _words(pairs: DataFrame) -> DataFrame:
    """``word, mid, stop, seen``: how often a word within a text is followed by
    another word, and by the end of a sentence. Only what has a next token
    counts, so cut tails do not teach their own words."""
    stop = F.col("b").rlike(r"^[#|.!?。！？…”»」』)\]]|^[\p{So}\p{Sk}]")
    mid = F.col("b").rlike(r"^[\p{L}\p{N}]")
    per = pairs.where(F.col("a").rlike(r"^[#\p{L}\p{N}]")).groupBy(F.col("a").alias("word"))
    return per.agg(F.sum(F.when(mid, F.col("n")).otherwise(0)).alias("mid"), F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("stop"), F.sum("n").alias("seen"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast, if it is small enough; joined by shuffle otherwise."""
    return F.broadcast(df) if df.count() <= RULES_UP_TO else df


def evidence(df: DataFrame, key: str, ident: str, source: str, text: str, min_seen: int = 5, rare_stop: float = 0.01, usual_share: float = 0.001) -> DataFrame:
    """``key, source, cut, reason`` of every row.

    Reasons, the first that holds: copy (another row of the same ``ident`` has
    a text that goes on where this ends), limit (as long as the source's field
    and not complete), mark (a mark where the source's cuts have it), broken (a
    torn character, escape or link at the end), torn (the last word is unknown
    and begins a known one), open (unclosed markup; an unclosed quote or bracket, or
    a last word that ends no sentence, where the source is known to lose ends or where
    it follows the word before it as usual). A null
    ``ident`` has no copies; a null ``source`` is held against the rules of all
    sources; null and empty texts are complete. Fields of which no source of the
    table shows a limit give no limit cuts. Trailing blanks do not count.
    ``min_seen`` is the least evidence; beyond it only shares decide, so more rows of the same kind are judged alike.
    """
    kind = df.schema[key].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(ident).alias("ident"), F.col(source).alias("source"), t.alias("text"))
    pairs = materialize(rows.select("text").mapInArrow(_pairs, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))

    # Of the different texts of a message in order, one that any other goes on from is followed by such a one.
    r = F.rtrim("text")
    texts = rows.where("ident IS NOT NULL").select("ident", r.alias("begin")).where("begin <> ''").repartition("ident").distinct()
    after = F.lead("begin").over(Window.partitionBy("ident").orderBy("begin"))
    short = texts.withColumn("after", after).where(F.col("after").startswith(F.col("begin"))).select("ident", "begin", F.lit(True).alias("goes_on"))
    copy = F.col("goes_on")
    beside = rows.withColumn("begin", r).join(short, ["ident", "begin"], "left")
    tails = beside.select("key", "source", "text", F.coalesce(copy, F.lit(False)).alias("copy")).mapInArrow(_describe, FEATURES.format(kind=kind)).persist(StorageLevel.MEMORY_AND_DISK)
    described = tails
    rules = _rules(tails)

    words = _words(pairs)
    links = pairs.where("a = '|link'").orderBy(F.desc("n"), "b").first()
    link = int(links["b"]) if links else 0
    known = words.where((F.col("seen") >= min_seen) & (F.length("word") <= LONGEST_WORD))
    begun = known.where(F.length("word") > 1).select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, 1, i))")).alias("word"), "seen")
    begun = begun.unionAll(df.sparkSession.createDataFrame([(x, 10**6) for x in ("h", "ht", "htt", "http", "https")], "word string, seen bigint"))
    # The words that stand last are far fewer than the rows; only they are judged.
    ending = tails.where("last IS NOT NULL").groupBy(F.coalesce("before", F.lit("")).alias("before"), F.col("last").alias("word")).agg(F.count(F.lit(1)).alias("ends"))
    judged = ending.join(begun.groupBy("word").agg(F.max("seen").alias("begins")), "word", "left").join(words, "word", "left").join(pairs.select(F.col("a").alias("before"), F.col("b").alias("word"), F.col("n").alias("together")), ["before", "word"], "left")
    judged = judged.join(words.select(F.col("word").alias("before"), F.col("seen").alias("seen_before")), "before", "left")
    seen, begins, stop = (F.coalesce(c, F.lit(0)) for c in ("seen", "begins", "stop"))
    # Against the known word only: a number of its own would be passed by fragments once there are rows enough.
    torn = (begins >= min_seen) & (seen < begins / 20 + 1) & (F.col("word") != "0")
    decided = F.coalesce("mid", F.lit(0)) + stop
    never = (seen >= min_seen) & (decided >= min_seen) & (stop < rare_stop * decided) & ~F.col("word").startswith("#")
    usual = (F.coalesce("together", F.lit(0)) >= F.greatest(F.lit(min_seen), usual_share * F.col("seen_before"))) & F.col("before").rlike(r"^[\p{L}\p{N}]")
    verdict = materialize(judged.select(F.col("before").alias("w1"), F.col("word").alias("w2"), torn.alias("torn"), never.alias("never"), usual.alias("usual")).where("torn OR never"))

    small = _bounded(rules)
    kept = small.where("unit = 'kept'").select(F.col("source").alias("s_kept"), F.col("form").alias("f_kept"), F.col("at").alias("a_kept"), F.lit(True).alias("marked"))
    joins = [(kept, F.col("source").eqNullSafe(F.col("s_kept")) & (F.col("form") == F.col("f_kept")) & (F.col("kept") == F.col("a_kept")))]
    for column, unit in {"chars": "chars", "octets": "octets", "raw_chars": "chars", "raw_octets": "octets"}.items():
        full = small.where(F.col("unit") == unit).select(F.col("source").alias(f"s_{column}"), F.col("at").alias(f"a_{column}"), F.lit(True).alias(f"full_{column}"))
        joins.append((full, F.col("source").eqNullSafe(F.col(f"s_{column}")) & (F.col(column) == F.col(f"a_{column}"))))
    for full, on in joins:
        tails = tails.join(full if small is rules else F.broadcast(full), on, "left")
    tails = tails.join(_bounded(verdict), (F.coalesce("before", F.lit("")) == F.col("w1")) & (F.col("last") == F.col("w2")), "left")

    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    torn_link = (F.col("link") > 0) & (F.col("link") < link)
    broken = F.col("broken") | torn_link
    finished = F.col("stopped") | ((F.col("link") > 0) & ~torn_link) | (F.col("tag") & ~yes("torn"))
    plain, any_text = F.col("form") == "", F.col("chars") > 0
    # At a blank in the field's last place the text went on, whatever stands before it.
    at_limit = plain & any_text & (((yes("full_chars") | yes("full_octets")) & ~finished) | ((yes("full_raw_chars") | yes("full_raw_octets")) & F.col("blank")))
    # By source: torn words tell how many texts lose their end; words no sentence ends with count
    # alone where they are no more than such cuts leave between words.
    free = tails.where(plain & ~F.col("copy") & ~at_limit & F.col("source").isNotNull()).groupBy("source").agg(F.sum((yes("torn") | broken).cast("int")).alias("a"), F.sum((yes("never") & ~broken).cast("int")).alias("b"), F.count(F.lit(1)).alias("n"))
    lossy = _bounded(materialize(free.where("b <= 0.6 * a AND a >= 0.01 * n").select(F.col("source").alias("s4"), F.lit(True).alias("lossy"))))
    tails = tails.join(lossy, F.col("source") == F.col("s4"), "left")
    reason = (
        F.when(F.col("copy"), "copy")
        .when(at_limit, "limit")
        .when(yes("marked"), "mark")
        .when(any_text & plain & broken, "broken")
        .when(plain & yes("torn"), "torn")
        .when(any_text & plain & F.col("markup"), "open")
        .when(plain & ((yes("never") & (yes("usual") | yes("lossy"))) | (F.col("unclosed") & yes("lossy")) | (F.col("lone") & F.col("last").isNotNull())), "open")
    )
    out = materialize(tails.select(F.col("key").alias(key), F.col("source"), reason.isNotNull().alias("cut"), reason.alias("reason")))
    described.unpersist()
    return out


def truncation_report(found: DataFrame) -> DataFrame:
    """``source, n, n_cut, share`` from the result of :func:`evidence`; the null source is one row."""
    per = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut").cast("int")).alias("n_cut"))
    return per.select("source", "n", "n_cut", F.round(F.col("n_cut") / F.col("n"), 6).alias("share"))
