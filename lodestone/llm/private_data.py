"""Personal data by weak supervision.

Four exact base patterns are always reported. Further candidates (numbers, long tokens, spelled-out addresses, names)
are voted on by labelers that may abstain: a regular expression for each kind, gazetteers (first names, token and
dialling prefixes, mail providers and top-level domains), the words before the span, and shapes that speak against it.
Candidates are found by their form alone; no labeler decides which spans are voted on, and no labeler votes for all of
them. Spans that no labeler votes for are the anchor of the estimate, known to be none, and never added; nor is anything of
a kind whose candidates all got the same votes. For each kind of its own,
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, without labelled data,
until it converges; its posteriors train the final span classifier (naive Bayes over features of the span), which
decides which candidates are added.

Only DataFrame functions are used. The texts are read once; vote patterns and feature values are few, whatever the
corpus (3 votes to the power of 4 labelers a kind), and only their counts reach the driver, where they are estimated.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, text_or_empty
from .scratch import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "secret", "address", "name")
#: Searches of the fixed patterns. A run of the first class can only match from its first character or from where the
#: last match ended, and repeated groups never have to give back what they took: the same matches in linear time.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Fixed gazetteers: common first names; prefixes of access tokens; dialling prefixes; mail providers and domains.
FIRST_NAMES = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph",
    "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Christopher", "Lisa", "Daniel", "Nancy", "Matthew", "Betty", "Anthony", "Margaret", "Mark", "Sandra",
    "Donald", "Ashley", "Steven", "Kimberly", "Paul", "Emily", "Andrew", "Donna", "Joshua", "Michelle", "Kenneth", "Carol", "Kevin", "Amanda", "Brian",
    "Dorothy", "George", "Melissa", "Edward", "Deborah", "Ronald", "Stephanie", "Timothy", "Rebecca", "Jason", "Laura", "Jeffrey", "Sharon", "Ryan",
    "Cynthia", "Jacob", "Kathleen", "Gary", "Amy", "Nicholas", "Angela", "Eric", "Anna", "Stephen", "Ruth", "Jonathan", "Brenda", "Larry", "Pamela",
    "Justin", "Nicole", "Scott", "Katherine", "Brandon", "Emma", "Benjamin", "Samantha", "Samuel", "Christine", "Frank", "Catherine", "Gregory", "Virginia",
    "Raymond", "Rachel", "Alexander", "Janet", "Patrick", "Maria", "Peter", "Hans", "Klaus", "Wolfgang", "Heinz", "Ursula", "Monika", "Petra", "Sabine",
    "Renate", "Stefan", "Andreas", "Jürgen", "Günther", "Pierre", "Jean", "Michel", "Philippe", "Nathalie", "Isabelle", "Sylvie", "Martine", "Carlos",
    "Juan", "José", "Luis", "Manuel", "Carmen", "Ana", "Isabel", "Pilar", "Antonio", "Francisco",
)
TOKEN_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "ya29.", "npm_", "pypi-", "hf_", "SG.", "dop_v1_")
DIALLING_PREFIXES = ("00", "01", "02", "03", "04", "05", "06", "07", "08", "09", "1-", "1 ", "(0", "(2", "(3", "(4", "(5", "(6", "(7", "(8", "(9")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "us", "ch", "at", "nl", "gmail", "yahoo", "outlook", "hotmail", "example")
_NUMBER = r"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
_SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
_ADDRESS = r"[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
_NAME = r"(?<![\p{L}0-9])\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}{2,}+(?![\p{L}0-9])"
_CONTEXT = {
    "number": r"(?i)(?:call|phone|tel|fax|mobile|account|card|ssn|passport|iban)[^\n]{0,12}$",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_ -]?key|bearer)[^\n]{0,6}$",
    "address": r"(?i)(?:mail|contact|write|reach)[^\n]{0,12}$",
    "name": r"(?i)(?:\b(?:mr|mrs|ms|dr|herr|frau|name|contact|author|signed|dear|sincerely|regards))[.:,]?\x20?$",
}
_STRONG = {
    "number": r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4})$",
    "secret": r"^(?:[0-9a-f]{32,}|[A-Z0-9]{20}|[A-Za-z0-9_-]{30,})$",
    "address": r"[(\[]dot[)\]]|\.[A-Za-z]{2,}$",
    "name": r"\x20\p{Lu}\p{Ll}+(?:son|sen|mann|ez|ski|sky|ova|vić|ford|berg|stein|bach|feld|hardt|elli|etti|ault|mura|moto)$|\x20(?:Mc|Mac|O')\p{L}+$",
}
#: Where the regular expression votes against.
_NEVER = {
    "number": r".",
    "secret": r"^[a-z]+(?:[_-][a-z]+)+[0-9]{0,4}$",
    "address": r"^.{120,}$",
    "name": r"(?i)^(\p{L}+)\x20\1$|^(?:\p{L}+\x20)?(?:und|and|oder|or|mit|with|von|der|die|das|que|les|des|los|las|est|dans|pour|para|como|sich|nicht|the)(?:\x20\p{L}+)?$",
}
_AGAINST = {
    "number": r"^(?:([0-9])\1+|[0-9]+\.[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+|[12][0-9]{3}[\x20.-][01]?[0-9][\x20.-][0-3]?[0-9])$|^[0-9]{8,}$",
    "secret": r"^[0-9]+$|^[A-Za-z]+(?:-[A-Za-z]+)*-?[0-9]{1,4}$",
    "address": r"^.{80,}$",
    "name": r"^(?:The|This|That|These|In|On|At|For|From|And|But|If|When|New|General|Der|Die|Das|Ein|Eine|Und|Le|La|Les|Un|Une|El|Los|Las|Il|Lo)\x20|(?:Street|Road|Avenue|University|Institute|City|County|River|Straße|Platz)$",
}
_quoted = lambda xs: "|".join(re.escape(x) for x in xs)
#: The gazetteers as patterns of a span.
_LISTED = {
    "number": f"^(?:{_quoted(DIALLING_PREFIXES)})",
    "secret": f"^(?:{_quoted(TOKEN_PREFIXES)})",
    "address": rf"(?i)(?:^|[^a-z])(?:{'|'.join(DOMAIN_ENDS)})$",
    "name": rf"^(?:{'|'.join(FIRST_NAMES)})\x20",
}
LABELERS = ("regex", "gazetteer", "context", "shape")
_FOUND = "array<struct<s:bigint,e:bigint,v:string>>"


#: Matches whose places are summed up one by one; longer lists are summed block by block.
_BLOCK = 128


def spans(text: Column, pattern: str, there: Column) -> Column:
    """Leftmost non-overlapping matches as (s, e, v) in code points; ``there`` is a cheap test that comes first.

    Places are prefix sums of the matches' and the gaps' lengths: inside blocks, then over the blocks, so that the cost
    of a text of many matches is not their number squared.
    """
    gaps = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), F.length(g).cast("long").alias("g")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    def in_blocks(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int"))
        local = F.transform(numbers, lambda k: F.aggregate(F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK)), start, add))
        return let(local, over_blocks)

    def over_blocks(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, o: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["v"].alias("v")))
        pairs = F.filter(F.arrays_zip(blocks.alias("b"), offsets.alias("o")), lambda p: p["b"].isNotNull())
        return F.flatten(F.transform(pairs, lambda p: moved(p["b"], p["o"])))

    few = lambda xs: F.when(F.size(xs) <= _BLOCK, F.aggregate(xs, start, add, lambda acc: acc["out"])).otherwise(in_blocks(xs))
    found = let(F.filter(gaps, lambda x: x["v"].isNotNull()), few)
    return F.when(there, found).otherwise(F.array().cast(_FOUND))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    each = F.filter(F.split(F.reverse(_digits(v)), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _numbered(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _base_spans(text: Column) -> Column:
    """Array of (s, k, e): k is the kind's number."""
    size = lambda x: F.length(_digits(x["v"]))
    found = [
        spans(text, _EMAIL, text.contains("@")),
        F.filter(spans(text, _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda x: x["v"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        F.filter(spans(text, _CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: size(x).between(14, 19) & F.when(size(x).between(14, 19), _luhn(x["v"])).otherwise(F.lit(False))),
        F.filter(spans(text, _PHONE, text.rlike(r"\+[0-9]")), lambda x: size(x).between(10, 15)),
    ]
    numbered = [F.transform(f, _numbered(k)) for k, f in enumerate(found)]
    return F.array_sort(F.concat(*numbered))


def _candidates(text: Column, base: Column) -> Column:
    """Array of (s, k, e, votes, features) that overlap no base span; votes: 1, 0 (abstains) or -1 for each labeler."""
    digit = text.rlike("[0-9]")
    found = {
        "number": spans(text, _NUMBER, digit),
        "secret": spans(text, _SECRET, digit),
        "address": spans(text, _ADDRESS, text.contains("at)") | text.contains("at]")),
        "name": spans(text, _NAME, F.lit(True)),
    }

    def describer(kind: str, k: int):
        def described(x: Column) -> Column:
            v = x["v"]
            before = F.substring(text, F.greatest(x["s"] - 29, F.lit(1)).cast("int"), F.least(x["s"], F.lit(30)).cast("int"))
            listed = v.rlike(_LISTED[kind])
            context = before.rlike(_CONTEXT[kind])
            regex = F.when(v.rlike(_STRONG[kind]), 1).when(v.rlike(_NEVER[kind]), -1).otherwise(0)
            votes = [regex, F.when(listed, 1).otherwise(0), F.when(context, 1).otherwise(0), F.when(v.rlike(_AGAINST[kind]), -1).otherwise(0)]
            share = F.floor(4 * F.length(_digits(v)) / F.length(v))
            features = [F.lit(kind), F.concat(F.lit(kind + "/length/"), F.least(F.floor(F.log2(F.length(v))), F.lit(8))), F.concat(F.lit(kind + "/digits/"), share), F.concat(F.lit(kind + "/context/"), context.cast("int")), F.concat(F.lit(kind + "/listed/"), listed.cast("int")), F.concat(F.lit(kind + "/shape/"), v.rlike(_STRONG[kind]).cast("int"), v.rlike(_AGAINST[kind]).cast("int")), F.concat(F.lit(kind + "/parts/"), F.least(F.size(F.split(v, r"[\x20().-]+")), F.lit(5)))]
            return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

        return described

    out = [F.transform(f, describer(kind, len(BASE_KINDS) + n)) for n, (kind, f) in enumerate(found.items())]
    return F.filter(F.concat(*out), lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))


Given = list[dict[int, tuple[float, float]]]


def estimate_reliability(patterns: list[tuple[tuple[int, ...], int]], most_rounds: int = 500, tolerance: float = 1e-6, anchored: bool = False) -> tuple[float, Given]:
    """EM over (votes, n) of one kind until nothing moves by more than ``tolerance``: the share of true spans, and for
    each labeler and vote its probability given no and given yes. Every count starts at one. ``anchored``: spans that no
    labeler votes for are known to be none."""
    prior, given = 0.5, [{1: (0.1, 0.5), 0: (0.6, 0.4), -1: (0.3, 0.1)} for _ in LABELERS]
    total = sum(n for _, n in patterns)
    for _ in range(most_rounds if total else 0):
        weighed = [(votes, n, 0.0 if anchored and 1 not in votes else n / (1 + math.exp(-log_odds(votes, prior, given)))) for votes, n in patterns]
        yes = sum(y for *_, y in weighed)
        no, before = total - yes, (prior, given)
        prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        given = [{v: ((sum(n - y for x, n, y in weighed if x[j] == v) + 1) / (no + 3), (sum(y for x, _, y in weighed if x[j] == v) + 1) / (yes + 3)) for v in (1, 0, -1)} for j in range(len(LABELERS))]
        moved = max(abs(a - b) for new, old in zip(given, before[1]) for v in new for a, b in zip(new[v], old[v]))
        if max(moved, abs(prior - before[0])) <= tolerance:
            break
    return prior, given


def log_odds(votes: tuple[int, ...], prior: float, given: Given) -> float:
    return math.log(prior / (1 - prior)) + sum(math.log(by[v][1] / by[v][0]) for by, v in zip(given, votes))


def _classifier(counts: list, posterior: dict[tuple, float]) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of a true span of each kind, and what each feature value adds: naive Bayes on the posteriors, from
    counts (kind, votes, feature, n); every span has its kind as a feature."""
    yes, n = Counter(), Counter()
    for kind, votes, feature, many in counts:
        yes[kind, feature] += many * posterior[kind, votes]
        n[kind, feature] += many
    start = {k: math.log((yes[k, f] + 1) / (n[k, f] - yes[k, f] + 1)) for k, f in n if k == f}
    weigh = lambda k, f: math.log(((yes[k, f] + 1) / (yes[k, k] + 2)) / ((n[k, f] - yes[k, f] + 1) / (n[k, k] - yes[k, k] + 2)))
    return start, {f: weigh(k, f) for k, f in n if k != f}


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added (arrays of kind, start, end; code points, end exclusive).

    Null and empty texts have no spans. Added spans overlap no base span; of added spans that overlap, all are given.
    Repeated rows repeat their result; null ids are kept; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text"))
    rows = rows.withColumn("base", _base_spans(F.col("__text")))
    found = materialize(rows.withColumn("more", _candidates(F.col("__text"), F.col("base"))).drop("__text"), "spans")
    each = found.where("size(more) > 0").select(F.explode("more").alias("c")).select("c.votes", "c.features")
    # At most 4 kinds x 81 vote patterns x some 30 feature values.
    counts = each.select("votes", F.element_at("features", 1).alias("kind"), F.explode("features").alias("f")).groupBy("kind", "votes", "f").agg(F.count("*").alias("n")).collect()
    counts = sorted((r["kind"], tuple(r["votes"]), r["f"], r["n"]) for r in counts)
    posterior = {}
    for kind in ADDED_KINDS:
        patterns = [(votes, n) for k, votes, f, n in counts if k == kind == f]
        prior, given = estimate_reliability(patterns, anchored=True)
        sure = lambda votes: 1 in votes and len(patterns) > 1  # labelers of whom none ever differs say nothing  # noqa: B023, E731
        posterior |= {(kind, votes): 1 / (1 + math.exp(-log_odds(votes, prior, given))) if sure(votes) else 0.0 for votes, _ in patterns}
    start, weights = _classifier(counts, posterior)

    named = lambda kinds: F.array(*map(F.lit, kinds))
    shown = lambda xs, kinds, shift: F.transform(xs, lambda x: F.struct(F.element_at(named(kinds), x["k"] - shift + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    if weights:
        table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
        begin = F.create_map(*[F.lit(x) for pair in sorted(start.items()) for x in pair])
        odds = lambda c: F.aggregate(c["features"], F.try_element_at(begin, c["features"][0]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        voted = lambda c: F.array_contains(c["votes"], 1)
        split = [k for k in ADDED_KINDS if len({votes for kind, votes, _, _ in counts if kind == k}) > 1]
        added = F.filter("more", lambda c: voted(c) & c["features"][0].isin(*split) & (odds(c) >= math.log(accept / (1 - accept)))) if split else F.filter("more", lambda c: F.lit(False))
    else:
        added = F.filter("more", lambda c: F.lit(False))
    return found.select("doc_id", shown(F.col("base"), BASE_KINDS, 0).alias("base"), shown(added, ADDED_KINDS, len(BASE_KINDS)).alias("added"))


def joined(xs: Column) -> Column:
    """kind:start:end by start, then kind in the order of the lists."""
    order = F.array(*[F.lit(k) for k in (*BASE_KINDS, *ADDED_KINDS)])
    keyed = F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
