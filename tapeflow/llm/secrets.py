"""Secret scans (DataFrame functions only).

Three base patterns (``assign``, ``access``, ``hex``) find the well-known
forms.  The method adds ``markov`` spans: runs of 16 or more key characters
that a character Markov model of random strings explains better than one of
ordinary identifiers, by log-likelihood ratio for each character.  A run that
does not pass as a whole is searched inside, so words joined to a key by
``/ + _ -`` (or by nothing) do not average it away:

* each segment between those signs of 16 or more characters is judged alone;
* the best stretches of 16 or more characters anywhere in the run (largest sum
  of log ratios above the threshold, one pass) count if half of them or more
  lie in segments of letters and digits mixed, as a search over all stretches
  of paths and names of plain words finds chance ones.  A stretch is reported
  from the start of its first segment to the end of its last.

Both models are first-order transition counts over labelled samples.  Random:
what the base patterns caught, and strings derived from hashes of the document
ids in the usual alphabets (hexadecimal in either case, base 64, its letters in
upper case).  Ordinary: all other runs of the corpus whose parts are only
letters or only digits, and a bounded labelled sample of the names that code is
full of (``ordinary_names``: camel case, snake case, constants, paths, numbers
in names).  The sample's transitions from a character weigh at least as much as
the corpus' from it, so neither a small corpus nor one without code leaves the
model without them.  The counts are a Spark aggregation over the whole corpus;
the model is a table of ``len(ALPHABET) + 1`` squared log ratios and reaches the
scan as a literal.

A regex match has no position in Spark SQL, so texts are cut into (gap, match)
pairs from the left, ``\\G(.*?)(pattern)``; summed lengths are the positions in
code points.  Patterns run only on texts that contain a match.

Defined cases: a null text is an empty text and has no spans (pass-through
columns keep the null).  Repeated rows are scanned each.  A null doc_id is
kept.  Base spans always stay; they are cut out of a run, and what is left of
it on either side is a run if still 16 characters long.  An empty table finds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.common import literal_table, stored

# Fixed values of the base scan.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

RUN_LENGTH = 16
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN_LENGTH
ORDINARY = r"^(?:[A-Za-z]+|[0-9]+)(?:[+/_-]+(?:[A-Za-z]+|[0-9]+))*[+/_=-]*$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SEGMENT = r"[A-Za-z0-9]{%d,}={0,2}" % RUN_LENGTH
PLAIN = r"(?<![A-Za-z0-9])(?:[A-Za-z]+|[0-9]+)(?![A-Za-z0-9])|[+/_=-]+"
STATES = len(ALPHABET) + 1  # state 0: the start of a run
SMOOTHING = 0.5
UNIFORM = 0.05              # share of chance in the model of ordinary names
LEAST_RATIO = 0.3           # nats for each character
CLOSING_DROP = 8.0          # nats lost after a stretch that end it
PLACEHOLDER = "[SECRET]"
# Words that the labelled sample of ordinary names is made of.
NAME_WORDS = """
abstract access account action adapter address admin agent alert alias amount analysis api app
archive array asset async auth average backend backup balance batch billing binary block body bool
boundary browser bucket buffer build builder byte cache callback category certificate channel char
check class cleanup client cluster code collection column command comment commit common component
config connection console container content context controller cookie copy counter country create
current custom customer daemon data database date debug decoder default delete deploy description
detail device dictionary directory display document domain download driver dynamic edge editor
element email encoder encryption engine entity entry environment error event exception executor
exchange export external factory failure feature fetch field file filter first folder format frame
function gateway generator global graph group guide handler hash header health helper history host
http identifier image implementation import index info initialize input instance integer interface
internal invoice item iterator java json keyboard kubernetes label language latest layout length
level library license limit line list listener load local location lock logger login manager map
member memory merge message metadata method metric middleware migration model module monitor name
network node notification number object offset operation option order output package page parent
parser partition path payment performance platform plugin pointer policy pool position prefix
previous process product profile project property protocol provider proxy public query queue random
range reader record redirect reference region register release remote render report repository
request resolver resource response result retry role root route runtime sample schedule schema
screen script search section segment select sequence serializer server service session setting
signature size snapshot socket source spec sql stack standard start state static status storage
stream string struct style subject success summary support switch symbol sync system table target
task template test text thread time timestamp total track transaction transform transport tree
trigger type unique update upload url user utility validate value variable vector vendor version
video view virtual visible wait warning web widget width window worker workflow wrapper write xml
yaml zone
""".split()
NAME_NUMBERS = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "12", "16", "24", "32",
                "64", "100", "128", "256", "512", "1024", "2020", "2024")


def _cut(text: Column, pattern: str, when: Column, value_group: int | None = None) -> Column:
    """Matches from the left as array<struct<gap, found, value>>."""
    p = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.transform(F.regexp_extract_all(text, p, F.lit(1)), F.length)
    found = F.regexp_extract_all(text, p, F.lit(2))
    value = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else found
    cut = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    empty = F.array().cast("array<struct<gap:int,found:string,value:string>>")
    return F.when(when, cut).otherwise(empty)


def _spans(cut: Column) -> Column:
    """(gap, found, value) → array<struct<start, end, value>> in code points."""
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.length(x["found"])
        span = F.struct(at.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
    return F.aggregate(cut, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind.  A run of hexadecimal or key characters is
    matched whole, so its least length can be part of the pattern; an
    assignment's value is judged after the match, as a short one uses it up."""
    hexes = f"[0-9a-f]{{{HEX_LENGTH},}}"
    access = f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"
    # A plain search for a character that every match has comes first.
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    assign = _spans(_cut(text, ASSIGN, sign & text.rlike(ASSIGN), 4))
    return {"assign": F.filter(assign, lambda s: F.length(s["value"]) >= ASSIGN_VALUE),
            "access": _spans(_cut(text, access, F.contains(text, F.lit("AKIA"))
                                  & text.rlike(access))),
            "hex": _spans(_cut(text, hexes, text.rlike(hexes)))}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _outside(run: Column, others: Column) -> Column:
    """What ``others`` (sorted by start) leave of ``run``, in pieces long enough."""
    start = F.struct(run["start"].alias("at"),
                     F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def with_piece(acc: Column, end: Column) -> Column:
        piece = F.struct(acc["at"].alias("start"), end.alias("end"), F.substring(
            run["value"], acc["at"] - run["start"] + 1, end - acc["at"]).alias("value"))
        return F.when(end - acc["at"] >= RUN_LENGTH,
                      F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])

    near = F.filter(others, lambda o: (o["start"] < run["end"]) & (run["start"] < o["end"]))
    return F.aggregate(
        near, start, lambda acc, o: F.struct(F.greatest(acc["at"], o["end"]).alias("at"),
                                             with_piece(acc, o["start"]).alias("out")),
        lambda acc: with_piece(acc, run["end"]))


def _worked_out(d: DataFrame, **columns: Column) -> DataFrame:
    """``d`` with more columns, each computed once for each row.  A plain
    projection would be merged with those that use it and its regular
    expressions run again at every use; a generator of one row is not."""
    return d.select("*", F.inline(F.array(F.struct(
        *(c.alias(name) for name, c in columns.items())))))


def with_runs(docs: DataFrame, keep: list[str], text: bool = True) -> DataFrame:
    """``keep`` columns, the spans of each base kind and the other runs of key
    characters, stored: training and scanning both start from here, so a text
    is searched once.  The text itself is kept if asked for."""
    t = F.col("__llm_text")
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__llm_text"))
    d = _worked_out(d, **{f"__llm_{k}": s for k, s in base_spans(t).items()},
                    __llm_runs=_spans(_cut(t, RUN, t.rlike(RUN))))
    d = _worked_out(d, __llm_base=F.array_sort(
        F.concat("__llm_assign", "__llm_access", "__llm_hex")))
    d = _worked_out(d, __llm_free=F.flatten(F.transform(
        "__llm_runs", lambda r: _outside(r, F.col("__llm_base"))))).drop("__llm_runs")
    return stored(d if text else d.drop("__llm_text"), "secret-runs")


def _states(run: Column) -> Column:
    """0 (start), then each character's place in the alphabet from 1; characters
    of a base value that are not in it are left out."""
    chars = F.split(run, "")
    return F.concat(F.array(F.lit(0)), F.filter(
        F.transform(chars, lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))),
        lambda s: s > 0))


def _moves(run: Column) -> Column:
    """Transition numbers (from × STATES + to) of a run."""
    s = _states(run)
    return F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
                      lambda a, b: a * STATES + b)


def ordinary_names(words: list[str] = NAME_WORDS) -> list[str]:
    """The labelled sample: for each of seven pairs of every word with others
    eight names, some with a number inside or behind, and two long numbers, as
    in orders, accounts and times."""
    out = []
    for i, one in enumerate(words):
        for step in (1, 2, 5, 17, 41, 89, 151):
            two, three = words[(i + step) % len(words)], words[(i + 3 * step) % len(words)]
            parts = [one, two, three]
            n = NAME_NUMBERS[(i + step) % len(NAME_NUMBERS)]
            big = [w.upper() if len(w) <= 4 and (i + step) % 2 else w.capitalize() for w in parts]
            out += [one + "".join(big[1:]), "".join(big), "_".join(parts), "-".join(parts),
                    "_".join(parts).upper(), "/" + "/".join(parts) + "-" + n,
                    one + n + "".join(big[1:]), "".join(big) + n]
            digits = str((i + 1) * (step + 2) * 7_919_191_919_191_927 % 10**16).zfill(16)
            out += [digits, f"{one}-{digits[:8]}-{digits[8:]}"]
    return out


def train(runs: DataFrame) -> list[float]:
    """Log ratio random : ordinary of every transition, from the runs of the
    whole corpus (``with_runs``, keeping doc_id) and the labelled names."""
    values = F.transform("__llm_base", lambda s: F.struct(F.lit(1).alias("kind"),
                                                         s["value"].alias("run")))
    plain = F.transform(F.filter("__llm_free", lambda r: r["value"].rlike(ORDINARY)),
                        lambda r: F.struct(F.lit(0).alias("kind"), r["value"].alias("run")))
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", "")
    made = F.array(*(F.struct(F.lit(1).alias("kind"), x.alias("run")) for x in (
        digest, F.upper(digest), base64, F.upper(base64))))
    names = literal_table(runs.sparkSession, [{"kind": 2, "run": n} for n in ordinary_names()],
                          "kind int, run string")
    moves = (runs.select(F.inline(F.concat(values, plain, made))).unionByName(names)
             .select("kind", F.explode(_moves(F.col("run"))).alias("move"))
             .groupBy("kind", "move").agg(F.count(F.lit(1)).alias("n")))
    count = [[0] * (STATES * STATES) for _ in range(3)]
    for r in moves.collect():  # at most 3 × STATES² rows
        count[r[0]][r[1]] = r[2]
    out = []
    for a in range(STATES):
        seen, random, named = (c[a * STATES:(a + 1) * STATES] for c in count)
        weight = max(1.0, sum(seen) / max(1, sum(named)))
        plain_row = [x + weight * y for x, y in zip(seen, named)]
        out += [round(math.log((y + SMOOTHING) / (sum(random) + SMOOTHING * STATES))
                      - math.log((1 - UNIFORM) * (x + SMOOTHING)
                                 / (sum(plain_row) + SMOOTHING * STATES)
                                 + UNIFORM / STATES), 6)
                for x, y in zip(plain_row, random)]
    return out


def _stretches(excess: Column) -> Column:
    """The best stretches of at least ``RUN_LENGTH`` of these numbers whose sum
    is not negative, as array<struct<start, end>> in order.  One pass: the sum
    so far against the least one ``RUN_LENGTH`` or more places before.  A
    stretch is closed when the sum has dropped ``CLOSING_DROP`` below its end's."""
    spans = "array<struct<start:int,end:int>>"
    none = F.lit(None).cast("double")

    def state(at, total, recent, low, low_at, best, top, start, end, out) -> Column:
        return F.struct(
            at.alias("at"), total.alias("total"), recent.alias("recent"), low.alias("low"),
            low_at.alias("low_at"), best.alias("best"), top.alias("top"), start.alias("start"),
            end.alias("end"), out.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["best"] >= 0, F.concat(acc["out"], F.array(
            F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))) \
            .otherwise(acc["out"])

    def moved(acc: Column, x: Column) -> Column:
        """One place on, with the least sum that a stretch ending here may start from."""
        far = F.size(acc["recent"]) == RUN_LENGTH
        before = F.get(acc["recent"], F.lit(0))
        new = far & (acc["low"].isNull() | (before < acc["low"]))
        total = acc["total"] + x
        return state(
            acc["at"] + 1, total,
            F.concat(F.when(far, F.slice(acc["recent"], 2, RUN_LENGTH - 1))
                     .otherwise(acc["recent"]), F.array(total)),
            F.when(new, before).otherwise(acc["low"]),
            F.when(new, acc["at"] + 1 - RUN_LENGTH).otherwise(acc["low_at"]),
            acc["best"], acc["top"], acc["start"], acc["end"], acc["out"])

    def judged(m: Column) -> Column:
        sum_here = m["total"] - m["low"]
        new = m["low"].isNotNull() & (m["best"].isNull() | (sum_here > m["best"]))
        over = (m["best"] >= 0) & (m["total"] < m["top"] - CLOSING_DROP)
        return F.when(F.coalesce(over, F.lit(False)), state(
            m["at"], m["total"], F.array(m["total"]), none, F.lit(0), none, none, F.lit(0),
            F.lit(0), closed(m))).otherwise(state(
                m["at"], m["total"], m["recent"], m["low"], m["low_at"],
                F.when(new, sum_here).otherwise(m["best"]),
                F.when(new, m["total"]).otherwise(m["top"]),
                F.when(new, m["low_at"]).otherwise(m["start"]),
                F.when(new, m["at"]).otherwise(m["end"]), m["out"]))

    start = state(F.lit(0), F.lit(0.0), F.array(F.lit(0.0)), none, F.lit(0), none, none,
                  F.lit(0), F.lit(0), F.array().cast(spans))
    return F.aggregate(excess, start, lambda acc, x: _let(moved(acc, x), judged), closed)


def _merged(spans: Column) -> Column:
    """Sorted array<struct<start, end>> with those that overlap as one."""
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (s["start"] < F.get(acc, F.size(acc) - 1)["end"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                          last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"))))) \
            .otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"),
                       step)


def _inside(value: Column, numbers: Column, ratio, least_ratio: float) -> Column:
    """Random parts of a run that does not pass as a whole (see the module), as
    array<struct<start, end>>; ``numbers`` are its log ratios by character."""
    segments = F.transform(
        F.filter(_spans(_cut(value, SEGMENT, value.rlike(SEGMENT))),
                 lambda s: ratio(s["value"]) >= least_ratio),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def to_segments(s: Column) -> Column:
        before = F.regexp_extract(F.reverse(F.substring(value, F.lit(1), s["start"])),
                                  "^[A-Za-z0-9]*", 0)
        after = F.regexp_extract(F.substring(value, s["end"] + 1, F.length(value)),
                                 "^[A-Za-z0-9]*=*", 0)
        return F.struct((s["start"] - F.length(before)).alias("start"),
                        (s["end"] + F.length(after)).alias("end"),
                        (s["end"] - s["start"]).alias("n"))

    def is_mixed(s: Column) -> Column:
        part = F.substring(value, s["start"] + 1, s["end"] - s["start"])
        return 2 * F.length(F.regexp_replace(part, PLAIN, "")) >= s["n"]

    best = F.transform(
        F.filter(F.transform(_stretches(F.transform(numbers, lambda x: x - least_ratio)),
                             to_segments), is_mixed),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return _merged(F.concat(segments, best))


def scanned(runs: DataFrame, model: list[float], least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``runs`` (see ``with_runs``) and ``__llm_spans``: all spans by start,
    then kind as listed, as array<struct<start, rank, end>> (rank: place in
    KINDS); ``__llm_n`` has the number of each kind."""
    ratios = F.expr("array(" + ",".join(f"{x!r}D" for x in model) + ")")  # a folded literal

    def numbers(run: Column) -> Column:
        return F.transform(_moves(run), lambda m: F.get(ratios, m))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)

    def random_parts(run: Column) -> Column:
        def parts(values: Column) -> Column:
            whole = F.array(F.struct(F.lit(0).alias("start"),
                                     F.length(run["value"]).alias("end")))
            return F.when(mean(values) >= least_ratio, whole).otherwise(_inside(
                run["value"], values, lambda v: mean(numbers(v)), least_ratio))
        return F.transform(_let(numbers(run["value"]), parts), lambda s: F.struct(
            (run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end")))

    def placed(rank: int) -> Column:
        return F.transform(f"__llm_{KINDS[rank]}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    d = _worked_out(runs, __llm_markov=F.flatten(F.transform("__llm_free", random_parts)))
    return _worked_out(
        d, __llm_spans=F.array_sort(F.concat(*map(placed, range(len(KINDS))))),
        __llm_n=F.struct(*(F.size(f"__llm_{k}").cast("long").alias(k) for k in KINDS)))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scan: DataFrame) -> DataFrame:
    """The scan's spans in words: counts per kind, digest of the base spans,
    and the list of all."""
    base = F.filter("__llm_spans", lambda s: s["rank"] < 3)
    return scan.select(
        "doc_id", F.col("__llm_n.assign").alias("n_assign"),
        F.col("__llm_n.access").alias("n_access"), F.col("__llm_n.hex").alias("n_hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("__llm_spans")).alias("spans"),
        F.col("__llm_n.markov").alias("n_markov"))


def redacted(scan: DataFrame) -> Column:
    """The text with every span (overlapping ones as one) replaced."""
    text = F.col("__llm_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.lit(PLACEHOLDER)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["out"], gap, mark).alias("out"))
    rest = F.aggregate("__llm_spans", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size("__llm_spans") > 0, rest).otherwise(F.col("text"))

