"""Secrets in texts, as character spans, by DataFrame functions alone.

Fixed kinds (base) come from patterns. Candidate strings, runs of base64 characters with a
digit, are then judged by the Shannon entropy of every window of WINDOW characters. The
entropy of a window is log2(W) - (1/W) * sum of c*log2(c) over its character counts c; one
fold over the candidate keeps the counts, five bits each in a few numbers, and that sum, adding
the entering character and taking the leaving one away: a step costs the same however long the
candidate is. c*log2(c) is kept in whole millionths, so sums are exact. Each
character class has its own threshold, and allow-listed candidates are suppressed. A
candidate's span reaches from its first to its last window above the threshold.

Spans are code points, end exclusive. A null text counts as empty and has no span; every row,
with or without doc_id, is judged by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.functions.vectors import let

# The base patterns.
WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.8}
UNIT = 1_000_000
ALLOWED = (
    "^[0-9]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^sha(1|256|384|512)-",
    "(?i)(example|sample|dummy|placeholder|changeme|xxxxxx|0123456789|1234567890|abcdefgh)",
)
MASK = "[SECRET]"
#: Bits of a count and counts in a 64-bit number; matches of a text that are placed together.
BITS, PACKED, MATCHES = 5, 12, 256
SPANS = "array<struct<start:long,kind:int,end:long>>"


def weight(count: int) -> int:
    return round(count * math.log2(count) * UNIT) if count else 0


def most(kind: str) -> int:
    """Largest sum of c*log2(c) that a window above the threshold of ``kind`` can have."""
    return math.floor(WINDOW * (math.log2(WINDOW) - THRESHOLDS[kind]) * UNIT)


def _found(text: Column, pattern: str, judge) -> Column:
    """Spans of the matches, leftmost and non-overlapping, that ``judge`` turns into spans.

    ``judge(match, start)`` gives an array of (start, end, kind). Splitting and extracting
    by one pattern alternate, so lengths add up to places. Matches are placed in blocks, and
    the blocks in the text, so a text of very many matches copies no long lists.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("before"), matches.alias("match"))
    empty = F.array().cast(SPANS)

    def step(state, pair):
        start = state["at"] + F.char_length(pair["before"])
        return F.struct(
            (start + F.char_length(pair["match"])).alias("at"),
            F.concat(state["spans"], judge(pair["match"], start)).alias("spans"),
        )

    def placed(pairs):
        begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(MATCHES))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(MATCHES)), begin, step))
        moved = lambda spans, by: F.transform(
            spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))
        )
        join = lambda state, b: F.struct(
            (state["at"] + b["at"]).alias("at"), F.concat(state["parts"], F.array(moved(b["spans"], state["at"]))).alias("parts")
        )
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        return F.aggregate(blocks, first, join, lambda state: F.flatten(state["parts"]))

    return F.when(F.size(matches) > 0, let(pairs, placed)).otherwise(empty)


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.array(F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end")))


def _base(kind: str, group: int = 0):
    def judge(match: Column, start: Column) -> Column:
        part = F.regexp_extract(match, ASSIGN, group) if group else match
        span = _span(start, start + F.char_length(match), kind)
        return F.when(F.char_length(part) >= LEAST[kind], span).otherwise(F.slice(span, F.lit(1), F.lit(0)))

    return judge


def _entropy(match: Column, start: Column) -> Column:
    """Span over the windows of one candidate that are above its class's threshold."""
    # What one more of a character adds to the sum when it has so many already.
    gains = F.array(*[F.lit(weight(c + 1) - weight(c)).cast("long") for c in range(WINDOW)])
    numbers = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    is_hex = match.rlike("^[0-9a-fA-F]+$")
    limit = F.when(is_hex, F.lit(most("entropy_hex"))).otherwise(F.lit(most("entropy_base64"))).cast("long")
    one = F.lit(1).cast("long")
    fields = [f"c{k}" for k in range(-(-len(ALPHABET) // PACKED))]

    def held(state, character):
        """How many of a character the window holds."""
        field = F.floor(character / PACKED).cast("int")
        value = F.lit(0).cast("long")
        for k, name in enumerate(fields):
            value = F.when(field == k, state[name]).otherwise(value)
        return F.call_function("shiftright", value, BITS * (character % PACKED)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def changed(state, character, by):
        """The counts with one more or less of a character; -1 stands for none."""
        field = F.floor(character / PACKED).cast("int")
        return {name: F.when(field == k, state[name] + by * F.call_function("shiftleft", one, BITS * (character % PACKED))).otherwise(state[name]) for k, name in enumerate(fields)}

    def step(characters, is_hex, limit):
        def run(state, i):
            leaving, entering = F.when(i >= WINDOW, F.get(characters, i - WINDOW)).otherwise(F.lit(-1)), F.get(characters, i)

            def less(state):
                gone = F.when(leaving >= 0, F.get(gains, held(state, leaving) - 1)).otherwise(F.lit(0).cast("long"))
                counts = changed(state, leaving, -1)
                return F.struct((state["sum"] - gone).alias("sum"), state["first"].alias("first"), state["last"].alias("last"), *[v.alias(n) for n, v in counts.items()])

            def more(state):
                total = state["sum"] + F.get(gains, held(state, entering))
                high = (i >= WINDOW - 1) & (total <= limit)
                return F.struct(
                    total.alias("sum"),
                    F.when(high & (state["first"] < 0), i).otherwise(state["first"]).alias("first"),
                    F.when(high, i).otherwise(state["last"]).alias("last"),
                    *[v.alias(n) for n, v in changed(state, entering, 1).items()],
                )

            return let(less(state), more)

        return run

    start_state = F.struct(
        F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), *[F.lit(0).cast("long").alias(n) for n in fields]
    )
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    judged = match.rlike("[0-9]") & ~allowed
    characters = F.transform(F.when(judged, F.split(match, "")).otherwise(F.array().cast("array<string>")), lambda c: F.get(numbers, F.ascii(c)))

    def spans(known):
        chars, is_hex, limit = known["characters"], known["is_hex"], known["limit"]
        order = F.when(F.size(chars) > 0, F.sequence(F.lit(0), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))

        def span(r):
            kind = F.when(is_hex, F.lit(KINDS.index("entropy_hex"))).otherwise(F.lit(KINDS.index("entropy_base64")))
            found = F.struct((start + r["first"] - WINDOW + 1).cast("long").alias("start"), kind.alias("kind"), (start + r["last"] + 1).cast("long").alias("end"))
            return F.filter(F.array(found), lambda _: r["last"] >= 0)

        return let(F.aggregate(order, start_state, step(chars, is_hex, limit)), span)

    return let(F.struct(characters.alias("characters"), is_hex.alias("is_hex"), limit.alias("limit")), spans)


def secret_spans(text: Column) -> Column:
    """All spans of a text, by start, then kind: array of (start, kind number, end)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = [
        _found(text, ASSIGN, _base("assign", 2)),
        _found(text, ACCESS, _base("access")),
        # Runs that are too short for a match need no place of their own.
        _found(text, f"[0-9a-f]{{{LEAST['hex']},}}", _base("hex")),
        _found(text, f"{CANDIDATE}+", _entropy),
    ]
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, secrets`` (array of start, kind, end) of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), secret_spans(F.col("text")).alias("secrets"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda s: s["kind"] < len(LEAST))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in LEAST],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def masked_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by MASK; n_chars follows where it is a column.

    Overlapping spans are replaced together; a null text stays null.
    """
    found = "_found_secrets"
    while found in docs.columns:
        found += "_"
    marked = docs.select("*", secret_spans(F.col("text")).alias(found))
    text, spans = F.col("text"), F.col(found)

    def step(state, s):
        piece = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(MASK))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], piece).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))
    columns = {"text": F.when(F.size(spans) > 0, clean).otherwise(text)}
    out = marked.withColumns(columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle() -> str:
    """DuckDB statement with the rows of ``digest(secrets(documents))``."""
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    weights = "[" + ", ".join(str(weight(c)) for c in range(WINDOW + 1)) + "]"
    assign = ASSIGN.replace("'", "''")
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)

    def places(pattern: str) -> str:
        return f"""SELECT doc, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS ms FROM d"""

    def spans(name: str) -> str:
        return f"""SELECT doc, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
            list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start
            FROM {name} WHERE len(ms) > 0"""

    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
pa AS ({places(assign)}), pk AS ({places(ACCESS)}), ph AS ({places(HEX)}), pc AS ({places(CANDIDATE)}),
sa AS ({spans('pa')}), sk AS ({spans('pk')}), sh AS ({spans('ph')}), sc AS ({spans('pc')}),
windows AS (
  SELECT doc, start, regexp_full_match(m, '[0-9a-fA-F]+') AS is_hex,
    list_transform(range(1, length(m) - {WINDOW - 2}), lambda i: list_sum(list_transform(list_distinct(string_split(substr(m, i, {WINDOW}), '')),
      lambda ch: ({weights})[1 + {WINDOW} - length(replace(substr(m, i, {WINDOW}), ch, ''))]))) AS sums
  FROM sc WHERE regexp_matches(m, '[0-9]') AND NOT ({allowed})),
high AS (
  SELECT doc, start, is_hex, list_filter(range(1, len(sums) + 1), lambda i: sums[i] <= CASE WHEN is_hex THEN {most('entropy_hex')} ELSE {most('entropy_base64')} END) AS hits
  FROM windows),
s AS (
  SELECT doc, start, 0 AS kind, start + length(m) AS stop FROM sa WHERE length(regexp_extract(m, '{assign}', 2)) >= {LEAST['assign']}
  UNION ALL SELECT doc, start, 1, start + length(m) FROM sk WHERE length(m) >= {LEAST['access']}
  UNION ALL SELECT doc, start, 2, start + length(m) FROM sh WHERE length(m) >= {LEAST['hex']}
  UNION ALL SELECT doc, start + hits[1] - 1, CASE WHEN is_hex THEN 3 ELSE 4 END, start + hits[-1] - 1 + {WINDOW} FROM high WHERE len(hits) > 0),
g AS (
  SELECT doc, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
    string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS every
  FROM s GROUP BY doc)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (doc)"""
