"""Variant spellings of names typed by people.

Method: merge-and-rematch resolution. Spellings are parsed into profiles: main words, and given names, trade or number. Of the
distinct words of a tenant and kind those that the matching rule lets pass for each other are found once, by the spellings one or
two deletions away; from them the sets of main words that match, each set beside those it may stand for. Profiles of matching
sets that mean the same are merged; a merged profile holds the words and initials of all, and this richer set is matched again,
with loose forms and with other merged profiles, until a round merges nothing more. Forms that say too little by themselves
(initials, nicknames of several names) are merged only into the one profile of the tenant they fit. A merged profile meets others
by any member's words and by the initials its members are written with; its given name, trade or number is the one its fuller
members say, as the other readings of a nickname are ruled out once it is merged.

What trades there are is learned from the names: a word that stands in many names of organisations, mostly not first, tells what
they do, not who they are. Shortened, clipped and mistyped forms are read as the trade they come from.

No block of names is ever gathered: profiles meet in equality joins. Sets of several words meet by those of their words that are
rare enough: of the words two sets share, the rarest is no commoner than the least common word of either, so commoner ones need
not be tried. Links go to components by joins. Mentions of different tenants never meet.

Defined results. Null or empty names link with nothing. A null or unknown type is read from the name (a model number: product; a
legal form or trade: organisation; else person). Repeated rows count once. Ties and order of rows do not matter. Extra
columns are ignored. A name made of trades alone is compared by them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.operators.graph import connected_components
from sparkloom.session import durable

# English given names and the short forms in use for them.
SHORT_FORMS = """
abigail: abby abbie gail; albert: al bert bertie; alexander: alex alec sandy sasha xander; alexandra: alex sandra sasha lexi; alfred: al alf fred; amanda: mandy; andrew: andy drew; anthony: tony ant
arthur: art artie; barbara: babs barb barbie; beatrice: bea trixie bee; benjamin: ben benny benji; catherine: cathy kate katie kit cat kitty; charles: charlie chuck chas; charlotte: lottie charlie; christine: chris tina chrissy; christopher: chris kit topher
daniel: dan danny; david: dave davy; deborah: deb debbie debby; donald: don donnie; dorothy: dot dottie dolly; edward: ed eddie ted ned teddy; eleanor: ellie nell nora nellie ella; elizabeth: liz beth betty eliza lizzie bess libby betsy; frances: fran frankie fanny francie; francis: frank frankie; frederick: fred freddie freddy fritz
gabriella: gabby ella gabi; gabriel: gabe; george: georgie; gerald: gerry jerry; gregory: greg; harold: harry hal; henry: harry hank hal; isabella: bella izzy; jacob: jake; james: jim jimmy jamie; jennifer: jen jenny; jessica: jess jessie; john: jack johnny jon
jonathan: jon jonny jonty nathan; joseph: joe joey; josephine: josie jo fifi posy; joshua: josh; katherine: kathy kate katie kit kitty; kenneth: ken kenny; kimberly: kim; lawrence: larry; leonard: len lenny leo; margaret: meg maggie peggy marge greta daisy; martha: marty; matthew: matt matty; michael: mike mick mickey
natalie: nat nattie tally; nathaniel: nat nate; nicholas: nick nico nicky; pamela: pam; patricia: pat trish patty tricia; patrick: pat paddy; penelope: penny pen nell; peter: pete; philip: phil pip; raymond: ray; rebecca: becky becca; richard: rick dick rich ricky; robert: rob bob bobby robbie bert; ronald: ron ronnie
samantha: sam sammy; samuel: sam sammy; stephen: steve stevie; susan: sue susie; susanna: sue susie sanna susan zanna; theodore: ted theo teddy; theresa: terry tess tessa tracy; thomas: tom tommy; timothy: tim timmy; victoria: vicky tori vic; vincent: vince vinny vin; virginia: ginny; walter: walt wally; william: will bill billy liam willie; winifred: winnie freda win
"""
TITLES = {"dr", "prof", "professor", "ing", "mr", "mrs", "ms", "mx", "miss", "sir", "madam", "herr", "frau", "dipl", "jr", "sr", "phd", "mba"}
LEGAL = {"inc", "incorporated", "ltd", "limited", "co", "company", "comp", "corp", "corporation", "gmbh", "mbh", "sa", "bv", "nv", "ag", "kg", "llc", "llp", "plc", "sarl", "srl", "spa", "the", "and", "und", "et", "group"}
TRADES = ("trading", "packaging", "electronics", "logistics", "manufacturing", "services", "chemicals", "engineering", "transport", "foods", "textiles", "consulting", "industries", "holding", "insurance", "construction", "energy", "pharmaceuticals", "software", "technologies", "partners", "international")
TRADE_SHORT = {"mfg": "manufacturing", "mfr": "manufacturing", "pkg": "packaging", "pkgs": "packaging", "svc": "services", "svcs": "services", "trdg": "trading", "trd": "trading", "engrg": "engineering", "fds": "foods", "txt": "textiles", "intl": "international", "tech": "technologies", "trspt": "transport"}
FORMAL: dict[str, set[str]] = {}
for _entry in re.split(r"[;\n]", SHORT_FORMS):
    if ":" in _entry:
        _name, _, _short = _entry.partition(":")
        for _x in (_name.strip(), *_short.split()):
            FORMAL.setdefault(_x, set()).add(_name.strip())
for _name in {n for s in FORMAL.values() for n in s}:
    FORMAL[_name] = {_name}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae")


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions, changes or swaps of neighbours turn a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    before, row = None, [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):  # only the diagonals within ``most`` can end there, so a long text costs no more than its length
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        if min(new[max(0, i - most) : i + most + 1]) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def allowed(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 7 else 2


class Trades:
    """The trades words can name: written out, in the singular, shortened, clipped or mistyped. Learned ones come after the fixed, the most frequent first."""

    def __init__(self, learned: tuple[str, ...] = ()):
        self.names = list(TRADES)
        self.cache: dict[tuple[str, str], str | None] = {}
        for w in learned:
            # a frequent shortened form of a trade, or a trade's other number, is none of its own
            if self.of(w, ".") is None and not any(_clipped(w, t) for t in learned if len(t) > len(w)):
                self.names.append(w)
                self.cache.clear()

    def of(self, word: str, mark: str) -> str | None:
        k = (word, mark)
        if k not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[k] = self._of(word, mark)
        return self.cache[k]

    def _of(self, word: str, mark: str) -> str | None:
        if word in self.names:
            return word
        if word in TRADE_SHORT:
            return TRADE_SHORT[word]
        if len(word) < 3:
            return None
        for fit in (lambda t: t.startswith(word), lambda t: len(word) >= 6 and near(word, t, 1), lambda t: t[-1] == "y" and word == t[:-1] + "ies", lambda t: _clipped(word, t, mark)):
            for t in self.names:
                if fit(t):
                    return t
        return None


def _clipped(word: str, trade: str, mark: str = "") -> bool:
    """Whether the word is the trade with letters left out: its beginning, or some of its letters in order where a point or the lack of vowels says so."""
    if trade.startswith(word):
        return True
    if len(word) < 3 or word[0] != trade[0] or not (mark == "." or (word[-1] == trade[-1] and not set(word) & set("aeiou"))):
        return False
    it = iter(trade)
    return all(c in it for c in word)


KNOWN = Trades()


def learned_trades(mentions: DataFrame, min_share: float = 0.005, min_names: int = 5, max_first: float = 0.3) -> tuple[str, ...]:
    """Words of five letters or more in at least min_share of the organisations' distinct names (min_names at least) and first in at most max_first of theirs, the most frequent first. By their share they are no more than the mean number of words of a name / min_share."""
    words = F.filter(F.split(F.lower("name"), r"[^\p{L}]+"), lambda w: w != "")
    org = F.lower(F.coalesce("etype", F.lit(""))).rlike("org|compan|supplier|customer|vendor")
    legal = F.arrays_overlap("words", F.array(*[F.lit(x) for x in sorted(LEGAL - {"the", "and", "und", "et", "co", "sa", "group"})]))
    named = mentions.select(F.lower("name").alias("name"), words.alias("words"), org.alias("org"), F.coalesce("etype", F.lit("")).alias("etype")).where(F.col("org") | ((F.col("etype") == "") & legal)).select("name", "words").distinct()
    # the blank word stands in every name
    seen = named.select(F.explode(F.array_union("words", F.array(F.lit("")))).alias("word"), F.col("words")[0].alias("first"))
    each = seen.where(((F.length("word") >= 5) & ~F.col("word").isin(*sorted(LEGAL | TITLES))) | (F.col("word") == "")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("word") == F.col("first")).cast("int")).alias("first"))
    total = each.where("word = ''").select(F.col("n").alias("total"))
    rows = each.join(F.broadcast(total)).where((F.col("word") != "") & (F.col("n") >= min_names) & (F.col("n") >= min_share * F.col("total")) & (F.col("first") <= max_first)).select("word", "n").collect()  # one row is broadcast
    return tuple(r.word for r in sorted(rows, key=lambda r: (-r.n, r.word)))


def kind_of(etype: str | None, name: str, trades: Trades = KNOWN) -> str:
    t = (etype or "").lower()
    if re.search(r"org|compan|supplier|customer|vendor", t):
        return "organization"
    if re.search(r"prod|item|material", t):
        return "product"
    if re.search(r"person|people|individual", t):
        return "person"
    words = re.findall(r"[a-z]+|\d+", fold(name).lower())
    if any(w.isdigit() and len(w) >= 2 for w in words):
        return "product"
    if any(w in LEGAL or trades.of(w, "") for w in words) or re.search(r"[&+]", name):
        return "organization"
    return "person"


def given_of(word: str) -> frozenset[str]:
    """The given names a word can stand for: itself, the names it is short for, or those it is a mistyped form of."""
    if word in FORMAL:
        return frozenset(FORMAL[word])
    close = set()
    if len(word) >= 4:
        for k, v in FORMAL.items():
            if len(k) >= 5 and near(word, k, 1 if len(k) < 8 else 2):
                close |= v
    return frozenset(close or {word})


def parse(kind: str, name: str, trades: Trades = KNOWN) -> dict | None:
    """The profile of a spelling: main words, and given names with initial (person), trade (organisation) or number (product)."""
    p = _read(kind, name, trades)
    return p and {"words": p["words"], "extra": p["extra"]}


def _read(kind: str, name: str, trades: Trades) -> dict | None:
    """The profile, and for a person the initial as written: b for Bob, whose given name is Robert."""
    plain = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", fold(name)).strip()
    plain = plain or fold(name)
    if kind == "person":
        if " " not in plain.strip() and "." in plain.strip("."):
            parts = [p for p in re.split(r"[._]", plain.split("@")[0]) if p]
            parts = [re.sub(r"\d+", "", p).lower() for p in parts]
            return _person(parts[:-1], parts[-1])
        comma = plain.split(",")
        if len(comma) > 1 and comma[1].strip() and comma[1].strip(" .").lower() not in TITLES:
            last = [w for w in re.findall(r"[^\W\d_]+", comma[0].lower()) if w not in TITLES]
            first = [w for w in re.findall(r"[^\W\d_]+", comma[1].lower()) if w not in TITLES]
            return _person(first, last[-1]) if last and first else None
        raw = [w for w in re.findall(r"[^\W\d_]+", plain) if w.lower() not in TITLES]
        if len(raw) == 1:
            split = re.findall(r"[A-Z][a-z]+", raw[0])
            raw = split if len(split) == 2 else raw
        words = [w.lower() for w in raw]
        if not words:
            return None
        if len(words) == 1:
            return _person([], words[0])
        caps = [len(w) > 1 and w.isupper() for w in raw]
        if len(words[-1]) == 1 and len(words[0]) > 1:
            return _person(words[-1:], words[0])
        if caps[0] and not caps[-1] and len(raw[-1]) > 1:
            return _person(words[1:], words[0])
        if not (caps[-1] and not caps[0]) and words[-1] in FORMAL and words[0] not in FORMAL and len(words[0]) > 1:
            return _person(words[1:], words[0])
        return _person(words[:-1], words[-1])
    if kind == "product":
        low = plain.lower()
        numbers = re.findall(r"\d+", low)
        words = [w for w in re.findall(r"[^\W\d_]+", low) if w not in {"model", "mod", "no", "nr", "type", "typ", "spare", "series", "ser"} and len(w) > 1]
        return {"words": tuple(words), "extra": ("-".join(numbers),)} if words and numbers else {"words": tuple(words), "extra": ("",)} if words else None
    plain = re.sub(r"\b([A-Za-z])\.\s*([A-Za-z])\.?(?=\s|$|,)(?:\s*([A-Za-z])\.)?", lambda m: " " + "".join(x for x in m.groups() if x) + " ", plain)
    plain = re.sub(r"\b(?:G\.?\s*)?m\.?\s*b\.?\s*H\b\.?", " gmbh ", plain, flags=re.IGNORECASE)
    plain = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", plain)
    words, found = [], set()
    for w, mark in re.findall(r"([^\W_]+)(\.?)", plain):
        w = w.lower()
        if w in LEGAL or len(w) == 1:
            continue
        t = trades.of(w, mark)
        if t:
            found.add(t)
        else:
            words.append(w)
    if not words:
        return {"words": tuple(sorted(found)), "extra": ()} if found else None
    return {"words": tuple(sorted(words)), "extra": tuple(sorted(found))}


def _person(first: list[str], last: str) -> dict:
    names = [w for w in first if len(w) > 1]
    if names:
        return {"words": (last,), "extra": tuple(sorted(given_of(names[0]))), "initial": names[0][0]}
    return {"words": (last,), "extra": (f"{first[0]}.",) if first else ("*",)}


def same_words(a: tuple, b: tuple) -> bool:
    """Whether two sets of main words can be matched one to one."""
    if len(a) != len(b):
        return False
    rest = list(b)
    for w in a:
        hit = next((x for x in rest if x == w), None) or next((x for x in rest if near(w, x, allowed(w, x))), None)
        if hit is None:
            return False
        rest.remove(hit)
    return True


PROFILE = "tenant string, etype string, name string, kind string, words array<string>, extra array<string>, initial string"


def profiles(mentions: DataFrame, trades: Trades = KNOWN) -> DataFrame:
    """One row per distinct name and type as they are written: tenant, etype, name, kind, words, extra, initial."""

    def run(batches):
        for df in batches:
            rows = []
            for t, e, n in df.itertuples(index=False):
                if isinstance(n, str) and n.strip():
                    kind = kind_of(e if isinstance(e, str) else None, n, trades)
                    p = _read(kind, n, trades)
                    if p:
                        rows.append((t, e, n, kind, list(p["words"]), list(p["extra"]), p.get("initial")))
            yield pd.DataFrame(rows, columns=["tenant", "etype", "name", "kind", "words", "extra", "initial"])

    return mentions.select("tenant", "etype", "name").distinct().mapInPandas(run, PROFILE)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row, fixed by writing it."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()))


def _near_words(batches):
    """Of pairs of words those the matching rule accepts, the greater word first."""
    for df in batches:
        rows = [(w, v) if x > y else (v, w) for w, v, x, y in zip(df["w"], df["v"], df["x"], df["y"]) if near(x, y, allowed(x, y))]
        yield pd.DataFrame(rows, columns=["w", "like"])


def like_words(words: DataFrame) -> DataFrame:
    """w, like: of words(tenant, kind, word, w) each beside the lesser ones of its tenant and kind that it may stand for. Pairs within one edit share a spelling one deletion away, those within two edits one of two."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    once = F.array_distinct(less(F.col("word")))
    deleted = F.when(F.length("word") < 7, once).otherwise(F.array_union(once, F.flatten(F.transform(once, less))))
    # Of words of over 62 letters within two edits, 20 letters at an end are the same, or the 16 from the 23rd on, moved by one at most
    ends = [F.concat(F.lit("<"), F.substring("word", 1, 20)), F.concat(F.lit(">"), F.substring("word", -20, 20)), *[F.concat(F.lit("="), F.substring("word", 23 + i, 16)) for i in (-1, 0, 1)]]
    none = F.array().cast("array<string>")
    keys = F.concat(F.array("word"), F.when(F.length("word") <= 64, deleted).otherwise(none), F.when(F.length("word") > 62, F.array(*ends)).otherwise(none))
    hashed = F.array_distinct(F.transform(keys, lambda k: F.xxhash64("tenant", "kind", k)))  # of two that are equal by chance the words are compared
    spread = max(words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a word makes dozens of rows
    keyed = words.where(F.length("word") >= 4).repartition(spread).select("w", F.explode(hashed).alias("key")).repartition("key")  # shuffled once for both sides
    pairs = keyed.join(keyed.select("key", F.col("w").alias("v")), "key").where("w < v").select("w", "v").distinct()
    x = words.select("w", "tenant", "kind", F.col("word").alias("x"))
    y = words.select(F.col("w").alias("v"), F.col("tenant").alias("t"), F.col("kind").alias("k"), F.col("word").alias("y"))
    return pairs.join(x, "w").join(y, "v").where("tenant = t and kind = k").select("w", "v", "x", "y").mapInPandas(_near_words, "w long, like long")


def _same_sets(batches):
    for df in batches:
        ok = [same_words(tuple(a), tuple(b)) for a, b in zip(df["wa"], df["wb"])]
        yield df[ok][["a", "b"]]


def like_sets(sets: DataFrame) -> DataFrame:
    """tid, other: sets(tenant, kind, words, tid) of main words beside those they match, themselves included."""
    each = sets.select("tenant", "kind", "tid", F.size("words").alias("k"), F.posexplode("words").alias("pos", "word"))
    words = _numbered(each.select("tenant", "kind", "word").distinct(), "w")
    likes = durable(like_words(words))
    at = durable(each.join(words, ["tenant", "kind", "word"]).select("tid", "k", "pos", "w"))
    one = at.where("k = 1").select("tid", "w")
    single = likes.join(one, "w").join(one.select(F.col("w").alias("like"), F.col("tid").alias("other")), "like").select(F.col("tid").alias("a"), F.col("other").alias("b"))
    # several words: each word's keys are itself and the lesser words it may stand for, so two that match share one at each of their words
    many = at.where("k > 1")
    keys = many.select("tid", "k", "pos", F.col("w").alias("key")).unionByName(many.join(likes, "w").select("tid", "k", "pos", F.col("like").alias("key")))
    rare = keys.join(keys.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")), ["k", "key"])
    most = rare.withColumn("m", F.max("n").over(Window.partitionBy("tid", "pos"))).withColumn("least", F.min("m").over(Window.partitionBy("tid")))  # a set's own words
    kept = most.where("n <= least and n > 1").select("tid", "k", "key").distinct()
    met = kept.select("k", "key", F.col("tid").alias("a")).join(kept.select("k", "key", F.col("tid").alias("b")), ["k", "key"]).where("a < b").select("a", "b").distinct()
    of = lambda x: sets.select(F.col("tid").alias(x), F.col("words").alias(f"w{x}"))
    several = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "wb").mapInPandas(_same_sets, "a long, b long")
    pairs = durable(single.unionByName(several))
    own = sets.select("tid", F.col("tid").alias("other"))
    return own.unionByName(pairs.toDF("tid", "other")).unionByName(pairs.select(F.col("b").alias("tid"), F.col("a").alias("other")))


def _fitting(rows: DataFrame, like: DataFrame) -> DataFrame:
    """a, b, by: each loose profile beside the strong ones it fits: by its given name, the initial of theirs (by 0) or one a member is written with (by 1); a name without trade or number fits any."""
    person = F.col("kind") == "person"
    dot = F.col("extra")[0].endswith(".")
    key = lambda k, by: F.struct(k.alias("key"), F.lit(by).alias("by"))
    any_ = F.array(key(F.lit(""), 0))
    letter = lambda x: F.substring(x, 1, 1)
    weak = rows.where(~F.col("strong") & (~person | (F.col("extra")[0] != "*")))
    asks = F.when(~person, F.array(F.lit(""))).when(dot, F.array(F.concat(F.lit("."), letter(F.col("extra")[0])))).otherwise(F.col("extra"))
    gives = F.when(~person, any_).otherwise(F.concat(F.transform("extra", lambda x: key(x, 0)), F.transform("extra", lambda x: key(F.concat(F.lit("."), letter(x)), 0)), F.transform("initials", lambda x: key(F.concat(F.lit("."), x), 1))))
    left = weak.select(F.col("cid").alias("a"), "tid", F.explode(asks).alias("key")).distinct().join(like, "tid").select("a", "other", "key").distinct()
    right = rows.where("strong").select(F.col("cid").alias("b"), F.col("tid").alias("other"), F.explode(gives).alias("g")).select("b", "other", "g.key", "g.by").distinct()
    return left.join(right, ["other", "key"]).groupBy("a", "b").agg(F.min("by").alias("by"))


def resolve(entities: DataFrame, key: str = "entity_id", tenant: str = "tenant_id") -> DataFrame:
    """key, tenant, name, cluster (a number): one row per mention; mentions of one cluster mean the same."""
    mentions = entities.select(F.col(key).alias("key"), F.col(tenant).alias("tenant"), F.coalesce("etype", F.lit("")).alias("etype"), "name").where("key is not null and tenant is not null and trim(name) <> ''").distinct()
    trades = Trades(learned_trades(mentions))  # bounded, see there
    spelled = durable(profiles(mentions, trades))
    distinct = _numbered(spelled.groupBy("tenant", "kind", "words", "extra").agg(F.array_sort(F.collect_set("initial")).alias("initials")), "pid")
    sets = _numbered(distinct.select("tenant", "kind", "words").distinct(), "tid")
    like = durable(like_sets(sets))
    enough = F.when(F.col("kind") == "person", (F.size("extra") == 1) & ~F.col("extra")[0].rlike("[.*]$")).otherwise((F.size("extra") > 0) & (F.array_join("extra", "|") != ""))
    profile = durable(distinct.join(sets, ["tenant", "kind", "words"]).select("pid", "tid", "kind", "extra", "initials", enough.alias("own")))
    # profiles of matching words that share the given name, trade or number
    said = profile.select("pid", "tid", "extra")
    links = said.join(like.where("tid < other"), "tid").join(said.select(F.col("pid").alias("b"), F.col("tid").alias("other"), "extra"), ["other", "extra"]).select(F.col("pid").alias("a"), "b")
    linked = connected_components(links).select(F.col("node").alias("pid"), F.col("component").alias("cid"))
    label = durable(profile.select("pid").join(linked, "pid", "left").select("pid", F.coalesce("cid", "pid").alias("cid")))
    again = False
    while True:  # each round but the last merges at least two clusters
        # a merged profile re-enters with all spellings of its members; it is strong once one of them says enough, and all then stand for what that one says
        now = profile.join(label, "pid")
        merged = now.groupBy("cid").agg(F.max("own").alias("strong"), F.max(F.when(F.col("own"), F.col("extra"))).alias("known"), F.array_distinct(F.flatten(F.collect_set("initials"))).alias("letters"))
        says = F.when(F.col("strong"), F.col("known")).otherwise(F.col("extra"))
        initials = F.when(F.col("strong"), F.array_sort("letters")).otherwise(F.array().cast("array<string>"))
        rows = now.join(merged, "cid").groupBy("cid", "tid", "kind", says.alias("extra"), "strong", initials.alias("initials")).agg(F.min(F.col("strong") & ~F.col("own")).alias("new"))
        rows = durable(rows)
        # the initial of a full name goes before that of a short form
        fit = _fitting(rows, like).groupBy("a", "by").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).groupBy("a").agg(F.min(F.struct("by", "n", "b")).alias("m"))
        moves = durable(fit.where("m.n = 1").select(F.col("a").alias("cid"), F.col("m.b").alias("to")))
        # strong ones meet by a word that a loose member brought; those whose words are their own have met before
        strong = rows.where("strong").select("cid", "tid", "extra", "kind", "new")
        meet = strong.where("new").join(like, "tid").select(F.col("cid").alias("a"), "other", "kind", "extra").join(strong.select(F.col("cid").alias("b"), F.col("tid").alias("other"), "kind", "extra"), ["other", "kind", "extra"])
        same = durable(meet.where("a <> b").select("a", "b").distinct()) if again else None
        moved, joined, again = moves.limit(1).count(), same is not None and same.limit(1).count(), True
        if not moved and not joined:
            break
        label = label.join(moves, "cid", "left").select("pid", F.coalesce("to", "cid").alias("cid"))
        if joined:
            label = label.join(connected_components(same).select(F.col("node").alias("cid"), F.col("component").alias("to")), "cid", "left").select("pid", F.coalesce("to", "cid").alias("cid"))
        label = durable(label)
    read = spelled.select("tenant", "etype", "name", "kind", "words", "extra").join(distinct.select("tenant", "kind", "words", "extra", "pid"), ["tenant", "kind", "words", "extra"]).join(label, "pid").select("tenant", "etype", "name", "cid")
    # the same name can be read as two kinds where types differ; each mention goes by its own
    return mentions.join(read, ["tenant", "etype", "name"]).select("key", "tenant", "name", F.col("cid").alias("cluster")).distinct()


def linked_pairs(resolved: DataFrame, block: int = 2000) -> DataFrame:
    """Each pair of different mentions of one cluster, the smaller key first.

    They grow with the square of a cluster, which the result asks for; a large cluster's are made in tiles of ``block`` mentions beside all its others.
    """
    one = resolved.select("cluster", "key").distinct()
    tiles = one.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", F.ceil(F.col("n") / block).cast("int").alias("tiles"))
    placed = one.join(tiles, "cluster")
    a = placed.select("cluster", F.col("key").alias("key_a"), F.pmod(F.xxhash64("key"), "tiles").cast("int").alias("tile"))
    b = placed.select("cluster", F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    return a.join(b, ["cluster", "tile"]).where("key_a < key_b").select("key_a", "key_b").distinct()
