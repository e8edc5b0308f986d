"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Both models are first-order chains over a reduced alphabet, trained from labelled samples and compared by their
log-likelihood ratio; everything on the executors is a DataFrame expression.
"""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import let, text_or_empty

#: The base patterns by kind, in the order in which spans of one start are listed, and what a match needs.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SKIP = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Strings that the models judge: runs that no word separator breaks, long enough for a ratio to mean something.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words that the sample of ordinary identifiers is built from (fixed values).
ORDINARY = (
    "account active address amount array average background batch begin block boolean bottom buffer build button cache "
    "callback cancel center change channel character check child class clear client close cluster code collection color "
    "column command comment common compare complete component config connect console constant contact container content "
    "context continue control convert copy count create current customer data database date debug default define delete "
    "description detail device dialog different direction directory display document domain double download driver "
    "element email empty enable encode endpoint engine error event example except execute expected export expression "
    "extension factory false feature field file filter final find first folder font format frame function general "
    "generate global graph group handler header height hidden history host image import index information initial input "
    "insert instance integer interface internal item iterator join keyboard label language last latest layout length "
    "level library limit line link list listener load local location logger login long loop main manager mapping margin "
    "master maximum member memory menu message metadata method minimum model module monitor mouse move multiple name "
    "native navigation network next node normal notification number object offset open operation option order original "
    "output package page panel parameter parent parse partition path pattern payment percent permission person picture "
    "pixel plugin point policy pool port position prefix previous print private process product profile program progress "
    "project property protocol provider public query queue random range read record reference region register relation "
    "release remote remove render replace report request require reset resource response result return revenue role root "
    "router row rule runtime sample save schedule schema screen script search section select sequence server service "
    "session setting shadow shape share signature simple size snapshot sort source space split stack standard start "
    "state statement static status step storage store stream string structure style subject submit success summary "
    "support switch symbol system table target task template temporary test text theme thread threshold time title "
    "toggle total trace track transaction transform translate tree trigger type unique unit unknown update upload user "
    "utility valid value variable vector vendor version video view visible volume warning weight widget width window "
    "worker workspace wrapper write"
).split()
#: Two-letter pieces of prose in several languages, for identifiers that no English list foresees (fixed values).
PIECES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ch ei ie un ge sc ai eu qu ue el la os ad ci".split()
#: The alphabet; all other characters share a symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio (natural log, per character) from which a candidate is a secret, and in total.
PER_CHAR, IN_ALL = 0.7, 12.0


def ordinary_samples(n: int = 6000) -> list[str]:
    """Labelled ordinary: identifiers of two to four words in the usual cases, long words of prose pieces, plain numbers, and rulers of one character."""
    out = []
    for i in range(n):
        h = hashlib.sha256(f"ordinary{i}".encode()).digest()
        words = [ORDINARY[(h[2 * k] * 256 + h[2 * k + 1]) % len(ORDINARY)] for k in range(2 + h[8] % 3)]
        style = h[9] % 8
        if style == 0:
            out.append("_".join(words))
        elif style == 1:
            out.append(words[0] + "".join(w.capitalize() for w in words[1:]))
        elif style == 2:
            out.append("-".join(words))
        elif style == 3:
            out.append("_".join(words).upper())
        elif style == 6:
            out.append("".join(str(b % 10) for b in h[10 : 26 + h[26] % 6]))
        elif style == 7:
            out.append("aexAX0189=-_+/"[h[10] % 14] * (16 + h[11] % 30))
        else:
            word = "".join(PIECES[b % len(PIECES)] for b in h[10:22])
            out.append((word, word.capitalize(), word.upper())[h[22] % 3 if style == 5 else 0])
    return out


def random_samples(n: int = 6000) -> list[str]:
    """Labelled random: digests written in hexadecimal, base 64, base 32 and as letters with digits."""
    out = []
    for i in range(n):
        h = hashlib.sha256(f"random{i}".encode()).digest()
        out.append((h.hex(), base64.b64encode(h).decode().rstrip("="), base64.b32encode(h).decode().rstrip("="), base64.b64encode(h[::-1], b"Xy").decode().rstrip("="))[i % 4][: 16 + h[0] % 25])
    return out


def train_chain(samples: list[str], smooth: float = 0.5) -> list[list[float]]:
    """Log transition probabilities with additive smoothing; symbol 0 stands for characters out of the alphabet."""
    n = len(ALPHABET) + 1
    index = {c: i for i, c in enumerate(ALPHABET, 1)}
    counts = [[smooth] * n for _ in range(n)]
    for s in samples:
        ids = [index.get(c, 0) for c in s]
        for a, b in zip(ids, ids[1:]):
            counts[a][b] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


def ratio_table(positive: list[str], negative: list[str]) -> list[float]:
    """log P_random - log P_ordinary for each pair of symbols, row by row."""
    return [round(p - q, 6) for a, b in zip(train_chain(positive), train_chain(negative)) for p, q in zip(a, b)]


def matches_with_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all leftmost non-overlapping matches, in code points.

    The gaps between matches, which ``split`` gives, and the matches themselves alternate, so running sums of their lengths
    are the positions.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = let(F.struct(gaps.alias("g"), found.alias("m")), lambda s: F.aggregate(
        F.sequence(F.lit(1), F.size(s["m"])),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out")),
        lambda acc, i: let(acc["at"] + F.length(F.element_at(s["g"], i)), lambda start: let(F.element_at(s["m"], i), lambda m: F.struct(
            (start + F.length(m)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")))).alias("out"),
        ))),
        lambda acc: acc["out"],
    ))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def ratio_sum(table: Column, value: Column) -> Column:
    """Log-likelihood ratio of ``value``; ``table`` holds ``ratio_table``."""
    n = len(ALPHABET) + 1
    symbol = lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0),
        lambda total, i: total + F.element_at(table, symbol(i) * n + symbol(i + 1) + 1),
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    positive: list[str] | None = None, negative: list[str] | None = None,
    per_char: float = PER_CHAR, in_all: float = IN_ALL,
) -> DataFrame:
    """One row per input row: doc_id, base and added (arrays of (start, kind, end), ends exclusive, code points).

    ``base`` holds what the fixed patterns find: leftmost non-overlapping matches of each kind, those that are too short
    dropped.  ``added`` holds candidate strings whose log-likelihood ratio reaches both ``in_all`` and ``per_char`` times
    their length and that overlap no base span.  The chains are trained from ``positive`` and ``negative`` labelled strings,
    by default the two generated samples.  A null text is the empty text and has no spans; repeated rows each give a row;
    other columns are ignored; an empty table gives no rows.  Whole texts are scanned and no row is shuffled.
    """
    weights = ratio_table(positive or random_samples(), negative or ordinary_samples())
    table = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<double>)")
    text = F.col("__text")
    spans = lambda kind, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    assign = F.filter(matches_with_spans(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8)
    access = F.filter(matches_with_spans(text, ACCESS), lambda m: F.length(m["value"]) >= 16)
    hexes = matches_with_spans(text, HEX.replace("+", "{32,}"))  # a run is a match as a whole or not at all
    base = F.array_sort(F.concat(spans("assign", assign), spans("access", access), spans("hex", hexes)))
    judged = F.filter(matches_with_spans(text, CANDIDATE), lambda m: let(ratio_sum(table, m["value"]), lambda x: (x >= in_all) & (x >= F.length(m["value"]) * per_char)))
    found = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text")).select("doc_id", base.alias("base"), judged.alias("judged"))
    free = F.filter("judged", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select("doc_id", "base", spans("markov", free).alias("added"))


def span_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans and the list of all spans."""
    kinds = F.array(*map(F.lit, KINDS))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda b: F.concat_ws(":", F.element_at(kinds, b["kind"] + 1), b["start"].cast("string"), b["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.size("added").cast("long").alias("n_added"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def oracle_sql() -> str:
    """The default scan's digest as DuckDB SQL; the trained ratios are written out."""
    n = len(ALPHABET) + 1
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    ratios = ", ".join(map(str, ratio_table(random_samples(), ordinary_samples())))

    def spans(kind: str, pattern: str, keep: str) -> str:
        p = quoted(pattern)
        found = f"regexp_extract_all(t, {p})"
        lengths = "list_sum(list_transform({}, lambda y: length(y)))"
        start = f"(coalesce({lengths.format('g[1:i]')}, 0) + coalesce({lengths.format('m[1:i-1]')}, 0))::BIGINT"
        return f"""(SELECT doc_id, list_filter([{{'s': {start}, 'k': {KINDS.index(kind)}, 'e': ({start} + length(m[i]))::BIGINT, 'v': m[i]}} for i in range(1, len(m) + 1)], lambda x: {keep}) AS {kind}
          FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, {found} AS m FROM d))"""

    symbol = lambda at: f"instr('{ALPHABET}', v[{at}])"
    joined = lambda s: f"array_to_string(list_transform({s}, lambda x: {list(KINDS)}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    cut = lambda s: f"list_transform({s}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT a.doc_id, assign, access, hex, list_sort({cut('assign')} || {cut('access')} || {cut('hex')}) AS base FROM
  {spans('assign', ASSIGN, f"length(regexp_extract(x.v, {quoted(ASSIGN)}, 2)) >= 8")} a
  JOIN {spans('access', ACCESS, 'length(x.v) >= 16')} c ON a.doc_id = c.doc_id JOIN {spans('hex', HEX.replace('+', '{32,}'), 'true')} h ON a.doc_id = h.doc_id),
ratios AS (SELECT unnest([{ratios}]::DOUBLE[]) AS r, generate_subscripts([{ratios}], 1) AS i),
candidates AS (SELECT doc_id, x.s AS s, x.e AS e, x.v AS v FROM (SELECT doc_id, unnest(markov) AS x FROM {spans('markov', CANDIDATE, 'true')})),
steps AS (SELECT doc_id, s, e, {symbol('j')} * {n} + {symbol('j + 1')} + 1 AS i FROM (SELECT *, unnest(range(1, length(v))) AS j FROM candidates)),
scored AS (SELECT doc_id, s, e FROM steps JOIN ratios USING (i) GROUP BY ALL HAVING sum(r) >= greatest({IN_ALL}, {PER_CHAR} * (e - s))),
added AS (SELECT b.doc_id, list_sort(list({{'s': s, 'k': 3, 'e': e}})) AS added FROM scored JOIN b USING (doc_id) WHERE len(list_filter(base, lambda y: y.s < e AND s < y.e)) = 0 GROUP BY 1),
f AS (SELECT b.*, coalesce(added, []) AS added FROM b LEFT JOIN added USING (doc_id))
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, len(added)::BIGINT AS n_added,
  sha256({joined('base')}) AS base_sha256, {joined('list_sort(base || added)')} AS spans FROM f"""
