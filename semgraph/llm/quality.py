"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

No rule decides alone and no labels are used. Each rule votes good, bad or nothing on a document; the
votes are counted by pattern over all documents (at most 3 to the number of rules patterns, whatever
the size of the corpus), and a two-class model is fitted to the counts in which a rule has, for good
and for bad documents, its own chances of each vote. A document is kept if its posterior of being good
reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, free_name, table, texts_of
from semgraph.session import materialize

QUERIES = Queries()

SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\f\r"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_capitals", "n_digits", "n_stops", "n_marked", "n_letters", "n_function")

# The most frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset("""
the of and to a in is it that for on with as was at by be this are from or an
le la les des et un une du en que qui dans pour pas sur au par est
der die das und ist von den mit zu im auf nicht ein eine es dem sich
el los las de y se por con para una del lo como su al
""".split())

#: Name, bad where, good where; elsewhere, and where both hold, the rule abstains.
RULES = (
    ("length", "n_words < 50", "n_words BETWEEN 80 AND 100000"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words",
     "word_chars BETWEEN 3.5 * n_words AND 9 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.01 * n_words"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines > 3"),
    ("capitals", "n_capitals > 0.3 * word_chars", "n_capitals < 0.06 * word_chars"),
    ("digits", "n_digits > 0.2 * word_chars", "n_digits < 0.02 * word_chars"),
    ("sentences", "n_stops < 0.01 * n_words", "n_stops BETWEEN 0.02 * n_words AND 0.3 * n_words"),
    ("marked_words", "n_marked > 0.2 * n_words", "n_marked < 0.02 * n_words"),
    ("letters", "n_letters < 0.7 * n_words", "n_letters > 0.95 * n_words"),
    ("function_words", "n_function < 0.03 * n_words", "n_function > 0.1 * n_words"),
)


def count_signals(text: str) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one text.

    Words end at ASCII white space. ``word_chars``: characters in words; ``n_symbols``: characters
    of ``SYMBOLS``; ``n_dup_lines``: lines with a word that equal an earlier line; ``n_lines``:
    lines with a word; ``n_repeat_words``: words inside three-word windows that occur twice or more;
    ``n_stops``: words that end a sentence; ``n_marked``: words with a symbol; ``n_letters``: words of
    letters and punctuation at their ends; ``n_function``: words of ``FUNCTION_WORDS``.
    """
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE_BYTES)]
    count = len(words)
    repeated = 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    kinds = np.array([_kinds(w) for w in number], np.int64).reshape(-1, 3)[ids].sum(0).tolist()
    if count > 3:
        size = len(number)
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        edges = np.zeros(count + 1, np.int64)
        starts = np.flatnonzero(times[which] > 1)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + 3, -1)
        repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    spaces = len(raw) - len(raw.translate(None, SPACE_BYTES))
    found = [len(raw) - len(raw.translate(None, chars)) for chars in (SYMBOLS, CAPITALS, DIGITS)]
    stops = sum(w[-1] in b".?:;" for w in words)
    return (count, len(text) - spaces, found[0], len(lines) - len(set(lines)), repeated, len(lines),
            found[1], found[2], stops, *kinds)


def _kinds(word: bytes) -> tuple[bool, bool, bool]:
    """Whether a word has a symbol, is letters but for punctuation at its ends, is a function word."""
    core = word.strip(b".,;:!?()\"'")
    spelt = core.decode()
    return len(word) != len(word.translate(None, SYMBOLS)), spelt.isalpha(), spelt.lower() in FUNCTION_WORDS


def signals(text: Column) -> Column:
    """``struct`` of ``COUNTS``, all long; a null text counts as empty."""

    @F.arrow_udf(f"struct<{', '.join(f'{name}: bigint' for name in COUNTS)}>")
    def counted(column: pa.Array) -> pa.Array:
        rows = [count_signals(t or "") for t in texts_of(column)]
        values = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
    return counted.asNondeterministic()(text)


def vote_pattern(struct: str) -> Column:
    """Votes of all rules as one number in base 3: 0 bad, 1 nothing, 2 good, first rule lowest."""
    total = F.lit(0)
    for k, (_, bad, good) in enumerate(RULES):
        of = {}
        for name, rule in (("bad", bad), ("good", good)):
            for count in COUNTS:
                rule = rule.replace(count, f"`{struct}`.{count}") if count in rule else rule
            of[name] = F.expr(rule)
        vote = F.when(of["bad"] & ~of["good"], 0).when(of["good"] & ~of["bad"], 2).otherwise(1)
        total = total + vote * 3 ** k
    return total


def fit_votes(votes: np.ndarray, times: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Posterior of being good for each row of ``votes`` (0, 1, 2), seen ``times`` times.

    Starts from the majority of the votes, which also tells the classes apart; chances are smoothed
    with one vote of each kind.
    """
    margin = (votes == 2).sum(1) - (votes == 0).sum(1)
    good = 1 / (1 + np.exp(-margin.astype(float)))
    for _ in range(rounds):
        logs = []
        for share in (1 - good, good):
            weight = share * times
            log = np.full(len(votes), np.log((weight.sum() + 1) / (times.sum() + 2)))
            for rule in votes.T:
                chance = np.array([weight[rule == v].sum() + 1 for v in range(3)])
                log += np.log(chance / chance.sum())[rule]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return new


def judge(scored: DataFrame, struct: str) -> DataFrame:
    """``scored`` (with ``signals`` in column ``struct``) and the posterior of each row as a last
    column, ``good_chance``. The rows are computed twice, for the counts and for the result; store them
    first. Missing signals abstain."""
    pattern, chance = free_name(scored.columns, "pattern"), free_name(scored.columns, "good_chance")
    voted = scored.withColumn(pattern, vote_pattern(struct))
    counted = voted.groupBy(pattern).agg(F.count("*").alias("n")).orderBy(pattern).collect()
    codes = np.array([row[pattern] for row in counted], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(RULES)) % 3
    times = np.array([row.n for row in counted], float)
    fitted = fit_votes(votes, times) if len(codes) else np.zeros(0)
    # at most 3 ** len(RULES) rows; of an Arrow table, as Python rows would start workers of their own on the executors
    posteriors = scored.sparkSession.createDataFrame(
        pa.table({pattern: pa.array(codes, pa.int32()), chance: pa.array(fitted, pa.float64())}))
    return voted.join(F.broadcast(posteriors), pattern, "left").drop(pattern)


def base_failed(struct: str) -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    n, repeated = F.col(f"`{struct}`.n_words"), F.col(f"`{struct}`.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def drop_low_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose posterior reaches ``threshold``.

    Null and empty texts fail. Equal texts get equal verdicts, repeated rows each their own. The
    model is fitted to the votes on all rows of ``docs``; with few rows it stays near their majority.
    The rows are stored once with their signals, which take longer to count than a copy of the texts to write.
    Columns may have any names.
    """
    struct = free_name(docs.columns, "signals")
    scored = materialize(docs.withColumn(struct, signals(F.col("text"))))
    judged = judge(scored, struct)
    kept = judged.filter(~base_failed(struct) & (F.col(judged.columns[-1]) >= threshold))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@QUERIES.add("op8_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    judged = judge(materialize(docs.select("doc_id", signals(F.col("text")).alias("signals"))), "signals")
    return judged.select(
        "doc_id", *[f"signals.{c}" for c in COUNTS[:5]], base_failed("signals").alias("base_failed"),
        (~base_failed("signals") & (F.col("good_chance") >= 0.5)).alias("kept"),
        F.round("good_chance", 6).alias("good_chance"))
