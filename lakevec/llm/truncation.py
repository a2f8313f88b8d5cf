"""Texts cut off by field limits or in transfer: significant length hazards, and a model of endings fitted to the texts themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakevec import runtime

#: Texts that what is known of an ending in all sources is worth against a source's own texts with that ending.
PRIOR = 20.0
#: Buckets of the logarithm of p in which tests are counted, to one.
STEPS = 64
#: Lengths on each side that give a length's neighbouring hazard, and the false-discovery rate of significant ones.
NEIGHBOURS, FALSE_DISCOVERY = 32, 0.01

COMPLETE, OPEN, BROKEN = "complete", "open", "broken"

_TERMINAL = ".!?。！？؟…⁉‼।"
_CLOSERS = "\"'»”’)]）」』*_~"
#: A line that systems add under a text whether or not it was cut: a category link or a template.
_ADDED_LINE = re.compile(r"\[\[[^\[\]\n|]{1,40}:[^\[\]\n]*\]\]|\{\{[^{}\n]*\}\}")
_BLOCK = re.compile(r"\{\{|\}\}|^\{\||^\|\}", re.MULTILINE)
_PART_OF_TAG = re.compile(r"</?[A-Za-z]*\Z|<[A-Za-z]+ [^<>\n]{0,80}\Z|&[a-zA-Z#0-9]{0,8}\Z")
_ELLIPSIS = re.compile(r"\s?(?:\.\.\.|…|\[(?:\.\.\.|…)\])\Z")
_URL = re.compile(r"(?:https?://)?[\w-]+(?:\.[\w-]+)+/\S*\Z")
_WORDS = re.compile(r"\w+|[^\w\s]+")
_TAGS = re.compile(r"<[^<>]*>")
_SENTENCE = re.compile(r"(?:[^\W\d_]+[,;]? ){2,}[^\W_]{4,}[.!?] +\S|[。！？]\s*\S")
#: Shapes of endings that are whole by themselves: a cut just there breaks nothing off.
FINISHED = r"^(empty|heading|(text|list|remark|redirect), (terminal|template|markup)\b.*|(row|redirect), (template|link)\b.*|text, link, .*)$"
_TAIL_MARKUP = ("</ref>", "&gt;", "-->", "/>")


def body(text: str) -> str:
    """text without white space at its end and without lines that are added under texts, unless these are all of it."""
    whole = t = text.rstrip()
    while (at := t.rfind("\n")) >= 0 and (not (line := t[at + 1 :].strip()) or _ADDED_LINE.fullmatch(line)):
        t = t[:at].rstrip()
    return t or whole


def _block_open(t: str) -> bool:
    """Whether a template or table is open at the end: one without its end before the next begins is only odd."""
    tables = t.count("\n{|") + t.startswith("{|") > t.count("\n|}") + t.startswith("|}")
    if not tables and t.count("{{") <= t.count("}}"):
        return False
    depth = 0
    for m in reversed(list(_BLOCK.finditer(t))):
        if m[0] in ("}}", "|}"):
            depth += 1
        elif not depth:
            return True
        else:
            depth -= 1
    return False


def _line_open(line: str) -> bool:
    """Whether the last line breaks off inside a link, reference or tag."""
    if line.count("[[") > line.count("]]") or line.endswith(("[", "{", "|", "<")) and not line.startswith("|"):
        return True
    if line.count("<ref") > line.count("</ref>") + line.count("/>") or line.count("&lt;ref") > line.count("&lt;/ref&gt;"):
        return True
    return bool(_PART_OF_TAG.search(line))


def _repeats(line: str) -> bool:
    """Whether a line mostly repeats itself, as vandalism does."""
    words = _WORDS.findall(_TAGS.sub("", line).lower())
    return not words or (len(words) > 2 and max(Counter(words).values()) * 5 >= 2 * len(words)) or (len(words) < 4 and line != _TAGS.sub("", line))


def _last(line: str) -> str:
    """The kind of a line's end: its last character without closing quotes and the like, or the markup that ends there."""
    if line.endswith("]]"):
        before = line[: line.rfind("[[")].rstrip()
        return "link after text" if before and before[-1].isalnum() else "link"
    if line.endswith(("}}", "|}")):
        return "template"
    if line.endswith(_TAIL_MARKUP):
        return "markup"
    c = line[-1]
    inner = line.rstrip(_CLOSERS)[-1:] or c
    if c in _TERMINAL or inner in _TERMINAL:
        return "terminal"
    if c in _CLOSERS:
        return "closer"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "upper" if c.isupper() else "letter"
    return "comma" if c in ",;،、，" else "other"


def _kind(line: str) -> str:
    """The kind of a line by its beginning."""
    if line.startswith("=="):
        return "heading" if line.endswith("==") and len(line) > 4 else "open heading"
    if line[:1] in "*#:;":
        return "redirect" if line[1:3].isupper() and line[0] == "#" else "list"
    if line[:1] in "|!":
        return "row"
    if line[:1] in "—–-~<(（":
        return "remark"
    return "text"


def shape(text: str) -> tuple[str, str]:
    """What stands under a text's end (tail) and the shape of the end: open markup, kind of the last line, how it ends and how long it is.

    White space, categories and templates under the text don't count, since they may be added after a cut, and neither do dots or a broken
    character that a cut leaves. These features only describe; which of them tell a cut is fitted (see endings).
    """
    t = body(text)
    if not t:
        return "none", "empty"
    tail = "added" if t != text.rstrip() else "none"
    if t.endswith("�"):
        t, tail = t.rstrip("�").rstrip() or "x", "broken character"
    elif (short := _ELLIPSIS.sub("", t)) != t and short:
        spaced = t[len(short)].isspace()
        t, tail = short.rstrip() or "x", "spaced dots" if spaced else "dots"
    line = t[t.rfind("\n") + 1 :].strip()
    kind = _kind(line)
    if kind in ("heading", "open heading"):
        return tail, kind
    markup = "block" if _block_open(t) else "line" if _line_open(line) else "quotes" if line.count("''") % 2 else "closed"
    if markup != "closed":
        return tail, f"{markup} open, {kind}"
    words = len(line.split(None, 12))
    long = "1" if words == 1 else "2-4" if words < 5 else "5-12" if words < 13 else "13-"
    end = _last(line)
    how = ""
    if end not in ("terminal", "template", "markup"):
        if kind == "list":
            how = ", of sentences" if _SENTENCE.search(line) else ""
        elif "°" in line and "′" in line:
            how = ", place"
        elif _URL.fullmatch(line):
            how = ", address"
        elif _repeats(line):
            how = ", repeats itself"
    return tail, f"{kind}, {end}, {long}{how}"


def _cut_at(text: str) -> int:
    """A place inside a text, by its hash."""
    return 1 + zlib.crc32(text[:256].encode(errors="ignore")) * 2654435761 % (1 << 32) % (len(text) - 1)


def lengths(text: str) -> list[str]:
    """The parts of a text whose lengths may be a limit: the text as it is, and without what was added after a cut.

    Where lines were added under a list item or table row, only the part above them can have been cut.
    """
    b = body(text)
    ways = [b, _ELLIPSIS.sub("", b)]
    if b == text.rstrip() or _kind(b[b.rfind("\n") + 1 :].strip()) not in ("list", "row"):
        ways += [text, text.rstrip("\r\n"), text.rstrip(), _ELLIPSIS.sub("", text)]
    if text.endswith("�"):
        ways.append(text.rstrip("�"))
    return [w for w in dict.fromkeys(ways) if w]


_SHAPE = "struct<tail: string, shape: string, cut: string, lengths: array<struct<unit: string, length: long, slack: int>>>"


def _shapes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    length = pa.struct([("unit", pa.string()), ("length", pa.int64()), ("slack", pa.int32())])
    kind = pa.struct([("tail", pa.string()), ("shape", pa.string()), ("cut", pa.string()), ("lengths", pa.list_(length))])
    for part in parts:
        rows = []
        for t in part.to_pylist():
            t = t or ""
            found = {}
            tail, end = shape(t)
            for w in lengths(t):
                found["chars", len(w)] = 0
                wide = len(w[-1].encode())
                size = len(w.encode())
                found["bytes", size] = max(found.get(("bytes", size), 0), wide - 1 if w[-1] != "�" else 3)
            cut = shape(t[: _cut_at(t)])[1] if len(t) > 1 else None
            rows.append({"tail": tail, "shape": end, "cut": cut, "lengths": [{"unit": u, "length": n, "slack": s} for (u, n), s in found.items()]})
        yield pa.array(rows, type=kind)


def endings(rows: DataFrame) -> DataFrame:
    """The model of endings: source, tail, shape, chance (of a text with this ending to be cut, by the ending alone) and share (of cut texts).

    Every text is also cut at one place by its hash; the shapes there give the rate of each shape at a cut. Endings are a mixture of cuts
    and of whole endings. The share of cut texts shows in the shapes that are likelier at a cut than at an end: so many of them need so many cuts.
    Of the texts with a shape, as many are cut as that share and the shape's rate at a cut explain; if there are more, the
    others end so by themselves. This is fitted to all texts, then to those with the same tail, since a cut leaves some tails (dots, lines added, none), then
    to those of each source, each time drawn towards the level above by PRIOR texts: a source whose whole texts end like cut ones shows it by their number.
    All counts are over all texts, equal ones of a source once; the number of shapes and tails is fixed by the features.
    """
    n = runtime.written(rows.groupBy("source", "tail", "shape").agg(F.count(F.lit(1)).alias("n")), "endings")
    cuts = rows.filter("cut IS NOT NULL").groupBy(F.col("cut").alias("shape")).agg(F.count(F.lit(1)).alias("r"))
    whole = Window.partitionBy()  # over at most as many rows as there are shapes
    by_shape = n.groupBy("shape").agg(F.sum("n").alias("n")).join(cuts, "shape", "full").na.fill(0, ["n", "r"])
    rates = by_shape.withColumns({"rate": F.coalesce(F.col("r") / F.sum("r").over(whole), F.lit(0.0)), "total": F.sum("n").over(whole)})
    rates = rates.withColumn("ref", F.col("rate") * F.col("total") > F.col("n"))
    rates = F.broadcast(runtime.written(rates.select("shape", "rate", "ref").coalesce(1), "cut-rates"))
    of_ref = F.broadcast(rates.filter("ref").agg(F.coalesce(F.sum("rate"), F.lit(1.0)).alias("ref_rate")))  # one row
    level = n.join(rates, "shape").crossJoin(of_ref)
    above: DataFrame | None = None
    for by in ([], ["tail"], ["source", "tail"]):
        # group by copies of the names, so that nulls and names of levels don't meet
        names = {c: f"l_{c}" for c in by}
        named = level.select("*", *(F.col(c).alias(x) for c, x in names.items()))
        groups = named.groupBy(*names.values(), F.lit(0).alias("l_all")).agg(F.sum("n").alias("l_total"), F.coalesce(F.sum(F.when(F.col("ref"), F.col("n"))), F.lit(0)).alias("l_ref"), F.max("ref_rate").alias("l_rate"))
        groups = groups.withColumn("l_share", F.least(F.lit(0.99), F.col("l_ref") / F.col("l_total") / F.col("l_rate")))
        counts = named.groupBy(*names.values(), F.col("shape").alias("l_shape")).agg(F.sum("n").alias("l_n"), F.max("rate").alias("l_at_cut"))
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        on = F.lit(True)
        for x in names.values():
            on = on & same(x, f"g_{x}")
        groups = groups.select(*(F.col(x).alias(f"g_{x}") for x in names.values()), "l_total", "l_share")
        fit = counts.join(F.broadcast(groups) if len(by) < 2 else groups, on)
        explained = F.least(F.col("l_n").cast("double"), F.col("l_total") * F.col("l_share") * F.col("l_at_cut"))
        if above is None:
            fit = fit.withColumn("chance", explained / F.col("l_n"))
        else:
            up = F.col("l_shape") == F.col("u_shape")
            if "tail" in by and len(by) > 1:
                up = up & same("l_tail", "u_tail")
            fit = fit.join(F.broadcast(above), up).withColumn("chance", (explained + PRIOR * F.col("u_chance")) / (F.col("l_n") + PRIOR))
        if len(by) < 2:
            above = fit.select(F.col("l_shape").alias("u_shape"), *(F.col(x).alias("u_" + x[2:]) for x in names.values()), F.col("chance").alias("u_chance"))
    return fit.select(F.col("l_source").alias("source"), F.col("l_tail").alias("tail"), F.col("l_shape").alias("shape"), "chance", F.col("l_share").alias("share"))


def shapes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Of every document its id, source, a hash of its text, its lengths, and by the model of endings the chance of a cut by its ending alone, as a table in the shared folder.

    state: broken if a cut is likelier than not, complete if the text ends with a sentence, heading or piece of markup, else open.
    """
    runtime.ship(docs.sparkSession)
    found = F.arrow_udf(_shapes, _SHAPE)(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("same"), found.alias("s"))
    rows = runtime.written(rows.select("doc", "source", "same", "s.*"), "endings")
    once = rows.groupBy("source", "same").agg(F.first("tail").alias("tail"), F.first("shape").alias("shape"), F.first("cut").alias("cut"))
    model = runtime.written(endings(once), "ending-model").select(F.col("source").alias("m_source"), F.col("tail").alias("m_tail"), F.col("shape").alias("m_shape"), "chance", "share")
    # rows of the model: shapes and tails, whose number is fixed, of each source
    at = F.col("source").eqNullSafe(F.col("m_source")) & (F.col("tail") == F.col("m_tail")) & (F.col("shape") == F.col("m_shape"))
    ended = F.col("shape").rlike(FINISHED)
    state = F.when(F.col("chance") > 0.5, BROKEN).when(ended, COMPLETE).otherwise(OPEN)
    return runtime.written(rows.join(model, at).select("doc", "source", "same", "tail", "shape", "chance", "share", state.alias("state"), "lengths"), "shapes")


def limits(shaped: DataFrame, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The significant lengths: source, unit, length, n (texts of this length), expected, p.

    The hazard of a length is the share of texts ending there among those at least as long. Equal texts
    of a source count once. Under the neighbouring hazard, that of the lengths at most neighbours away, the number of ends is about
    Poisson; p is the Chernoff bound of its upper tail, so that it is never too small. Significant lengths keep
    to the false-discovery rate over all tests (Benjamini and Hochberg), and more of their texts end
    broken than complete. All statistics are over all texts. The windows run over distinct lengths of a source, and over the
    tests that alone reach the rate.
    """
    per_text = shaped.groupBy("source", "same").agg(F.first("state").alias("state"), F.first("lengths").alias("lengths"))
    each = per_text.select("source", "state", F.explode("lengths").alias("l")).select("source", "state", "l.unit", "l.length")
    counts = each.groupBy("source", "unit", "length").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("state") == BROKEN, 1)).alias("n_broken"), F.count(F.when(F.col("state") == COMPLETE, 1)).alias("n_complete")
    )
    by_length = Window.partitionBy("source", "unit").orderBy("length")
    near = by_length.rangeBetween(-neighbours, neighbours)
    longer = by_length.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    tests = counts.withColumns({"at_risk": F.sum("n").over(longer), "beside": F.sum("n").over(near) - F.col("n")})
    hazard = (F.col("beside") + 0.5) / (2.0 * neighbours * F.col("at_risk"))
    tests = tests.withColumn("expected", hazard * F.col("at_risk"))
    log_p = F.when(F.col("n") > F.col("expected"), F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected"))).otherwise(F.lit(0.0))
    tests = tests.withColumn("p", F.exp(log_p))
    total = tests.agg(F.count(F.lit(1)).alias("m"))
    # tests are counted by buckets of log p, of which there is a bounded number; all of a bucket have at most its upper edge
    step = F.greatest(F.ceil(F.greatest(log_p, F.lit(-700.0)) * STEPS), F.lit(-700 * STEPS)).cast("int")
    kept = tests.filter(F.col("p") <= rate).withColumn("step", step)
    counted = kept.groupBy("step").agg(F.count(F.lit(1)).alias("k")).withColumn("rank", F.sum("k").over(Window.orderBy("step")))
    passing = counted.crossJoin(F.broadcast(total)).filter(F.exp(F.col("step") / F.lit(float(STEPS))) <= rate * F.col("rank") / F.col("m")).agg(F.max("step").alias("last"))
    found = kept.crossJoin(F.broadcast(passing)).filter((F.col("step") <= F.col("last")) & (F.col("n_broken") > F.col("n_complete")))
    return found.select("source", "unit", "length", "n", "at_risk", "expected", "p")


def truncated(shaped: DataFrame, significant: DataFrame) -> DataFrame:
    """The cut texts: doc, source, cause (limit or transfer).

    At a significant length of its source all texts are cut but the expected number; those are flagged whose ending isn't finished, and likelier
    cut than not with that share. Elsewhere the ending alone tells, by the model, and a cut is put down to the transfer. A limit in
    bytes may leave up to a character's bytes unused. Documents without a source form a group.
    """
    each = shaped.filter(F.col("shape") != "empty").select("doc", "source", "state", "chance", "share", F.explode("lengths").alias("l"))
    fits = each.select("doc", "source", "state", "chance", "share", F.col("l.unit").alias("unit"), F.explode(F.sequence(F.col("l.length"), F.col("l.length") + F.col("l.slack"))).alias("length"))
    cut_here = F.greatest(F.col("n") - F.col("expected"), F.lit(0.0)) / F.greatest(F.col("expected"), F.lit(0.1))
    s = significant.select(F.col("source").alias("s_source"), F.col("unit").alias("s_unit"), F.col("length").alias("s_length"), cut_here.alias("here"))
    at = fits.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("unit") == F.col("s_unit")) & (F.col("length") == F.col("s_length")), "left")
    per = at.groupBy("doc", "source", "state", "chance", "share").agg(F.max("here").alias("here"))
    # the odds of the ending alone, with the share of cut texts at the length instead of the source's
    odds = F.col("chance") / (1.0001 - F.col("chance")) * (1 - F.col("share")) / F.greatest(F.col("share"), F.lit(1e-6)) * F.col("here")
    limit = F.coalesce((F.col("state") != COMPLETE) & (odds > 1), F.lit(False))
    return per.filter(limit | (F.col("state") == BROKEN)).select("doc", "source", F.when(limit, "limit").otherwise("transfer").alias("cause"))


def rates(shaped: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source: n_docs, n_cut, n_at_limit and the rate of cut texts. Null sources count as one."""
    found = cut.groupBy(F.col("source").alias("c_source")).agg(F.count(F.lit(1)).alias("n_cut"), F.count(F.when(F.col("cause") == "limit", 1)).alias("n_at_limit"))
    docs = shaped.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    zero = F.lit(0).cast("long")
    both = docs.join(found, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return both.select("source", "n_docs", F.coalesce("n_cut", zero).alias("n_cut"), F.coalesce("n_at_limit", zero).alias("n_at_limit"), (F.coalesce("n_cut", zero) / F.col("n_docs")).alias("rate"))
