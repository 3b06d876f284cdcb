"""Free-typed values mapped to the closest entry of a reference list.

All entries and their alias paths lie in one trie of squeezed texts (lower-case letters and digits). A value is
squeezed too and walked down the trie with a Levenshtein automaton (insertions, deletions, replacements and swapped
neighbours cost 1), which returns every entry within a distance that depends on the entry's length.

A value may hold more than its label, so every stretch of its words is tried. A reading costs its distance over the
entry's length, and SKIP for each word that it leaves out: words after a sign (a remark) and words before a colon,
equals sign or closing bracket (a tag) cost nothing, nor do words the column itself shows to be no part of labels:
those that stand right beside an exact entry in at least SEEN of the values that hold one (so there are at most
2 / SEEN of them). The cheapest reading within the limit wins; then the longer entry, then the smaller id.

The trie goes along with the code; longer lists than TRIE_ENTRIES are cut into several tries by the hash of the entry,
each value being tried against all of them one after the other. Records are mapped without a shuffle, each distinct
value once per worker (a dictionary of bounded size). Defined results: null and blank values are left out, as are
values that equal an entry; a value that fits none has id -1; repeated rows get equal ids; of entries equal after
squeezing the smaller id stands; an empty reference list matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.mojibake import plausible
from flowloom.runtime import if_small, stored

UNMATCHED = -1
KEPT = 200_000
# Other names of the classes.
ALIASES = {
    "BENIGN": ("benign/normal", "benign traffic", "benign flow", "normal", "normal traffic"),
    "Bot": ("a bot", "bot traffic", "botnet"),
    "DDoS": ("ddos attack", "distributed dos", "distributed denial of service", "d.d.o.s."),
    "DoS GoldenEye": ("goldeneye", "golden eye", "goldeneye dos", "dos: golden-eye", "denial of service goldeneye", "denial of service - goldeneye"),
    "DoS Hulk": ("hulk", "hulk dos", "dos: hulk", "denial of service hulk"),
    "DoS Slowhttptest": ("slow http test", "slowhttptest dos", "slow http", "dos slow-http-test", "denial of service slowhttptest", "slow http dos"),
    "DoS slowloris": ("slow loris", "slowloris dos", "dos: slow-loris", "denial of service slowloris"),
    "DoS Thimblerig": ("thimblerig", "thimblerig dos", "denial of service thimblerig"),
    "FTP-Patator": ("patator ftp", "ftp (patator)", "ftp patator brute force", "ftp brute force"),
    "SSH-Patator": ("patator ssh", "ssh (patator)", "ssh patator brute force", "ssh brute force"),
    "Heartbleed": ("openssl heartbleed", "heartbleed bug"),
    "Infiltration": ("infiltr", "infiltrate", "network infiltration"),
    "PortScan": ("port scanning", "scan of ports"),
    "Web Attack - Brute Force": ("web bruteforce", "brute force (web)", "webattack bf", "webattack bf brute force", "web attack bf"),
    "Web Attack - Sql Injection": ("sql injection", "sqli", "sql inj. web", "web sqli", "web sql injection", "webattack sqli"),
    "Web Attack - XSS": ("xss", "web xss", "xss web", "cross-site scripting", "xss (web)"),
    "Web Attack - Path Walk": ("path walk", "path walk web", "web path walk", "walking paths", "web: walking paths"),
    "Web Attack - File Drop": ("file drop", "web file drop", "dropped file", "file drop web", "dropped file (web)"),
    "Telnet-Guesser": ("guesser telnet", "telnet guessing", "telnet password guesser", "guesser (telnet)"),
    "Remote Desktop Guesser": ("remote desktop guessing", "rdp guesser", "rdp guessing", "guesser remote desktop"),
    "DNS Tunnel": ("dns tunneling", "dns tunnelling", "tunnel over dns"),
    "Ping Sweep": ("ping sweeping", "sweep", "sweep of pings"),
    "Cryptominer": ("coin cryptominer", "crypto mining", "crypto miner"),
    "Ransom Beacon": ("ransom beaconing", "beacon of ransom tool"),
    "Worm Spread": ("worm spreading", "spreading worm"),
    "UDP Flood": ("udp flooding", "flood udp", "flooding (udp)"),
    "Credential Stuffing": ("stuffing of credentials", "cred stuffing", "credentials stuffed"),
    "Data Exfiltration": ("data exfil", "exfil of data", "exfiltration"),
    "Session Hijack": ("hijacked session", "session hijacking", "sess hijack"),
    "Printer Abuse": ("abuse of printer",),
    "Rogue Gateway": ("gateway rogue", "rogue gw"),
    "Clock Skewing": ("clock skew", "skewed clock"),
    "Mail Relay Misuse": ("misuse of mail relay", "relay misuse", "mailrelay misuse"),
    "Lateral Movement": ("lateral mvmt", "lateral move", "moving laterally"),
}
SKIP, EXACT_LIMIT, NEAR_LIMIT = 0.15, 0.5, 0.35
SEEN = 0.001
TRIE_ENTRIES = 100_000
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"[:=)\]}>#]")
_REMARK = re.compile(r"[-–—/,;:(\[{|?!*.\]\x80-\x9f�\t]|[^\x00-\x7F\xa0]")


def squeeze(text: str) -> str:
    return "".join(_WORD.findall(unicodedata.normalize("NFKC", text).lower()))


def reach(length: int) -> int:
    """The distance allowed for an entry of this length."""
    return 0 if length < 3 else 1 if length <= 5 else 2 if length <= 10 else 3


class Trie:
    """Entries (squeezed text: ids); each path ends in all ids it stands for."""

    def __init__(self, entries: dict[str, list[int]]):
        self.root: dict = {}
        for text, ids in entries.items():
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (sorted(ids), len(text))

    def near(self, word: str) -> list[tuple[int, int, int]]:
        """(distance, id, entry length) of all entries within their reach of the word."""
        n, found = len(word), []
        most = reach(n + 3)
        # the automaton's state after a path is the row of its edit distances to each start of the word
        walk = [(self.root, list(range(n + 1)), None, "")]
        while walk:
            node, row, above, last = walk.pop()
            for c, below in node.items():
                if c == "":
                    ids, length = below
                    if row[n] <= reach(length):
                        found += [(row[n], i, length) for i in ids]
                    continue
                new = [row[0] + 1]
                low = new[0]
                for j in range(1, n + 1):
                    v = row[j - 1] if word[j - 1] == c else 1 + min(row[j - 1], row[j], new[j - 1])
                    if above is not None and j > 1 and word[j - 1] == last and word[j - 2] == c and above[j - 2] + 1 < v:
                        v = above[j - 2] + 1
                    new.append(v)
                    if v < low:
                        low = v
                if low <= most:
                    walk.append((below, new, row, c))
        return found


class Matcher:
    """Maps values; keeps those it has met, and the stretches it has looked up, in dictionaries of bounded size."""

    def __init__(self, entries: dict[str, int], aliases: dict[str, tuple[str, ...]], beside: frozenset[str] = frozenset()):
        self.exact: dict[str, list[int]] = {}
        for text, number in [*entries.items(), *((a, entries[c]) for c, others in aliases.items() if c in entries for a in others)]:
            if squeeze(text):
                self.exact.setdefault(squeeze(text), []).append(number)
        texts = sorted(self.exact)
        self.tries = [Trie({t: self.exact[t] for t in texts[i : i + TRIE_ENTRIES]}) for i in range(0, len(texts), TRIE_ENTRIES)]
        self.longest = max(map(len, self.exact), default=0)
        self.beside = beside
        self.kept: dict[str, int] = {}
        self.looked: dict[str, tuple | None] = {}

    def __call__(self, value: str) -> int:
        if (known := self.kept.get(value)) is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            known = self.kept[value] = self._match(value)
        return known

    def _match(self, value: str) -> int:
        for text in dict.fromkeys((value if value.isascii() else plausible(value), value)):
            stretches = self.stretches(text)
            known = [(cost, -len(s), min(self.exact[s])) for s, cost in stretches if cost <= EXACT_LIMIT and s in self.exact]
            if known and min(known)[0] == 0:
                return min(known)[-1]
            found = [(r[0] + cost, *r[1:]) for s, cost in stretches if cost < NEAR_LIMIT and (r := self._closest(s)) and r[0] + cost <= NEAR_LIMIT]
            if known or found:
                return min(known + found)[-1]
        return UNMATCHED

    def _closest(self, stretch: str) -> tuple[float, int, int] | None:
        """(distance over length, -length, id) of the best entry."""
        if stretch not in self.looked:
            if len(self.looked) >= KEPT:
                self.looked.clear()
            self.looked[stretch] = min(((d / length, -length, i) for t in self.tries for d, i, length in t.near(stretch)), default=None)
        return self.looked[stretch]

    def _words(self, text: str) -> tuple[list[str], list[str]]:
        """The words, and the signs before, between and after them."""
        text = unicodedata.normalize("NFKC", text.replace("\xa0", " "))
        at = list(_WORD.finditer(text.lower()))
        ends = [0, *(w.end() for w in at)]
        return [w[0] for w in at], [text[e : w.start()] for e, w in zip(ends, at, strict=False)] + [text[ends[-1] :]]

    def stretches(self, text: str) -> list[tuple[str, float]]:
        """Squeezed stretches of a value's words, with the cost of the words left out."""
        words, gaps = self._words(text)
        n, out = len(words), {}
        price = [0.0 if w in self.beside else SKIP for w in words]
        after = [0.0] * (n + 1)  # of leaving out the words from here on: up to the next sign
        for i in range(n - 1, -1, -1):
            after[i] = 0.0 if _REMARK.search(gaps[i]) else price[i] + after[i + 1]
        before = 0.0
        for start in range(n):
            if _TAG.search(gaps[start]):
                before = 0.0
            joined = ""
            for end in range(start, n):
                joined += words[end]
                if len(joined) > self.longest + 3:
                    break
                cost = before + after[end + 1]
                if cost < out.get(joined, 9.0):
                    out[joined] = cost
            before += price[start]
        return list(out.items())

    def neighbours(self, value: str) -> tuple[bool, set[str]]:
        """Whether the value holds an exact entry, and the words right beside the longest one that no sign parts from it."""
        words, gaps = self._words(value)
        best = max(((len(j), a, z) for a in range(len(words)) for z in range(a, len(words)) if (j := "".join(words[a : z + 1])) in self.exact), default=None)
        if best is None:
            return False, set()
        _, a, z = best
        sides = ([words[a - 1]] if a and not _TAG.search(gaps[a]) else []) + ([words[z + 1]] if z + 1 < len(words) and not _REMARK.search(gaps[z + 1]) else [])
        return True, set(sides)


def map_values(df: DataFrame, id_col: str, text_col: str, entries: DataFrame, number: str, name: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id_col, number): one row per record whose text is not null, not blank and no entry itself."""
    spark = df.sparkSession
    known = entries.select(number, name).where(F.col(name).isNotNull()).orderBy(number).collect()  # the reference list
    numbers = {r[1]: int(r[0]) for r in reversed(known)}
    names = entries.select(F.col(name).alias("__name")).distinct()
    open_rows = df.select(id_col, text_col).where(F.col(text_col).rlike(r"(?U)\S")).join(if_small(names), F.col(text_col) == F.col("__name"), "left_anti")
    lists = spark.sparkContext.broadcast((numbers, ALIASES if aliases is None else aliases))

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, seen = Matcher(*lists.value), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                exact, words = match.neighbours(text)
                seen.update(words)
                seen[""] += exact
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    values = open_rows.groupBy(F.col(text_col).alias("text")).agg(F.lit(1))
    counted = values.select("text").mapInPandas(beside, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    total = counted.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = frozenset(r["word"] for r in counted.where((F.col("word") != "") & (F.col("n") >= max(2, total * SEEN))).collect())  # at most 2 / SEEN
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(*lists.value, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([match(t) for t in b.column(1).to_pylist()], pa.int64())], names=[id_col, number])

    return open_rows.mapInArrow(run, T.StructType([df.schema[id_col], T.StructField(number, T.LongType(), True)]))
