"""Secrets in texts: spans that fixed patterns give, and strings that look drawn at random rather than written.

Two Markov chains of characters, one of random strings and one of ordinary identifiers, are trained from labelled strings.
A string is a secret if the first makes it much likelier than the second. All of it is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordering import checkpointed

# What assignments, access keys and hexadecimal strings look like, and their least lengths.
ASSIGN_NAMES = "password|passwd|secret|token|api_?key"
ASSIGN_REST = "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the chains judge are JUDGED characters or longer; ordinary identifiers are those of letters and underscores.
STRING, JUDGED = "[A-Za-z0-9+/_=-]{12,}", 16
ORDINARY = "^[A-Za-z_]+$"
#: Characters are their ASCII codes; 1 is any other, 0 the place before the first.
CODES = 128
#: Added to the count of each of the ALPHABET characters that may follow another.
SMOOTHING, ALPHABET = 0.5, 65
#: So often a random string's next character is any of the alphabet, as the samples may be of few kinds only.
ANY = 0.2
#: A string is a secret if the chain of random strings makes it e ** THRESHOLD times as likely.
THRESHOLD = 4.0


def either_case(names: str) -> str:
    """A pattern whose letters A-Z stand for both cases, and for no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


ASSIGN = f"({either_case(ASSIGN_NAMES)}){ASSIGN_REST}"
#: A run of hexadecimal digits or of an access key is matched whole or not at all, so its length can be in the pattern.
ACCESS = f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = f"[0-9a-f]{{{HEX_LEAST},}}"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also where the body is a loop that uses it in each round."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """For each place of an array the sum of what stands before it.

    Sums of blocks of about sqrt(n) first, so that n numbers take n ** 1.5 steps and not their square.
    """
    zero = F.lit(0).cast("bigint")
    add = lambda a, b: a + b

    def sums(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")

        def with_blocks(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")),
                                 lambda b: F.aggregate(F.slice(a, b * width + 1, width), zero, add))
            # blocks before each block
            starts = let(blocks, lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), zero, add)))
            return let(starts, lambda s: F.transform(a, lambda _, i: F.get(s, F.floor(i / width).cast("int")) + F.aggregate(
                F.slice(a, F.floor(i / width).cast("int") * width + 1, i % width), zero, add)))

        return let(width, with_blocks)

    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(let(numbers, sums))


def found_spans(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, in order: array of (start, end, match), in code points.

    The text between the matches gives their places.
    """
    def placed(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches,
                           lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size")))
        return let(steps, lambda s: let(
            running_sums(F.transform(s, lambda x: x.gap + x["size"])),
            lambda before: F.transform(matches, lambda m, i: F.struct(
                (F.get(before, i) + F.get(s, i).gap).alias("start"),
                (F.get(before, i) + F.get(s, i).gap + F.get(s, i)["size"]).alias("end"), m.alias("match")))))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


# --- chains ------------------------------------------------------------------------------------------------------


def transitions(string: Column) -> Column:
    """Codes of neighbouring characters as previous * CODES + next, the first with 0 before it."""
    codes = F.transform(F.split(string, ""), lambda c: F.when((c > " ") & (c <= "~") & (F.length(c) == 1), F.ascii(c)).otherwise(F.lit(1)))
    return F.when(F.length(string) == 0, F.array().cast("array<int>")).otherwise(
        let(codes, lambda a: F.transform(a, lambda c, i: F.when(i == 0, c).otherwise(F.get(a, i - 1) * CODES + c))))


def train(samples: DataFrame) -> DataFrame:
    """One row with `weights`: for each transition the log of its probability in random strings over that in ordinary ones.

    `samples` holds (strings array<string>, label): 1 for random strings, 0 for ordinary identifiers; each occurrence
    counts. Transitions are added up on the map side; at most CODES ** 2 of either label go on. Without samples all
    weights are 0.
    """
    counts = samples.select("label", F.explode("strings").alias("string")).select(
        "label", F.explode(transitions(F.col("string"))).alias("at")).groupBy("at").agg(
        F.count_if(F.col("label") == 1).alias("random"), F.count_if(F.col("label") == 0).alias("ordinary"))
    kinds = ("random", "ordinary")
    before = counts.groupBy(F.floor(F.col("at") / CODES).alias("previous")).agg(*[F.sum(c).alias(f"all_{c}") for c in kinds])
    places = samples.sparkSession.range(CODES * CODES).select(
        F.col("id").cast("int").alias("at"), F.floor(F.col("id") / CODES).alias("previous"))

    def share(c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(0)) + SMOOTHING) / (F.coalesce(F.col(f"all_{c}"), F.lit(0)) + SMOOTHING * ALPHABET)

    rows = places.join(counts, "at", "left").join(before, "previous", "left").select(
        "at", F.log((ANY / ALPHABET + (1 - ANY) * share("random")) / share("ordinary")).alias("weight"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("rows")).select(
        F.transform("rows", lambda r: r.weight).alias("weights"))


def log_likelihood_ratio(string: Column, weights: Column) -> Column:
    return F.aggregate(transitions(string), F.lit(0.0), lambda total, at: total + F.get(weights, at))


# --- documents ---------------------------------------------------------------------------------------------------


def _place(span: Column) -> Column:
    return F.struct(span.start.alias("start"), span.end.alias("end"))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id with the spans of each pattern and the strings to be learned from and judged, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    spans = docs.select(
        "doc_id", F.filter(found_spans(text, ASSIGN), lambda s: F.length(value(s.match)) >= ASSIGN_LEAST).alias("assign"),
        found_spans(text, ACCESS).alias("access"), found_spans(text, HEX).alias("hex"), found_spans(text, STRING).alias("strings"))
    apart = let(F.concat("assign", "access", "hex"), lambda base: F.when(F.size(base) == 0, F.col("strings")).otherwise(
        F.filter("strings", lambda c: ~F.exists(base, lambda s: (s.start < c.end) & (c.start < s.end)))))
    kinds = [F.transform(k, _place).alias(k) for k in KINDS[:3]]
    match = lambda s: s.match
    random = F.concat(F.transform("assign", lambda s: value(s.match)), F.transform("access", match), F.transform("hex", match))
    found = spans.select("doc_id", *kinds, random.alias("random"), apart.alias("strings"))
    return found.select(
        "doc_id", *KINDS[:3], "random",
        F.transform(F.filter("strings", lambda s: s.match.rlike(ORDINARY)), match).alias("ordinary"),
        F.filter("strings", lambda s: F.length(s.match) >= JUDGED).alias("candidates"))


def span_list(*kinds: str) -> Column:
    """kind:start:end of the columns' spans by start, then in the order of the kinds, joined by commas."""
    def marked(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("kind"), s.end.alias("end")))

    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*[marked(n, k) for n, k in enumerate(kinds)])), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the spans (start, end) of each kind in its whole text, as arrays `assign`, `access`, `hex` and `markov`.

    The patterns' matches are the labelled random strings, over all documents; strings of 12 or more letters and
    underscores that overlap none of them are the ordinary identifiers. Such strings of 16 or more characters of any kind
    are judged by the chains. Null and empty texts have no spans; equal texts have equal ones; ids may be null or repeat. Other columns are
    not read. An empty table gives no rows; without matches of the patterns or without ordinary words to learn from, no
    string is added.
    """
    rows = checkpointed(base_spans(docs))
    samples = rows.select(F.col("random").alias("strings"), F.lit(1).alias("label")).unionByName(
        rows.select(F.col("ordinary").alias("strings"), F.lit(0).alias("label")))
    known = rows.agg((F.max(F.size("random")) > 0) & (F.max(F.size("ordinary")) > 0))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    judged = F.filter("candidates", lambda c: log_likelihood_ratio(c.match, F.col("weights")) > threshold)
    # only rows with something to judge are given the weights
    return rows.where(F.size("candidates") == 0).select("doc_id", *KINDS[:3], none.alias("markov")).unionByName(
        rows.where(F.size("candidates") > 0).withColumns({"known": known.scalar(), "weights": train(samples).scalar()}).select(
            "doc_id", *KINDS[:3], F.when(F.col("known"), F.transform(judged, _place)).otherwise(none).alias("markov")))
