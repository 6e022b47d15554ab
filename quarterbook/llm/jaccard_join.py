"""N-gram Jaccard join: components of documents whose shingle sets are alike, by prefix tokens and tries of ordered sets.

Shingles are ordered by how common they are (classes from a table of fixed size that counts all shingles) and then by
hash. Two sets of similarity 80 % share a shingle among the first fifth of each, so documents meet under such tokens.
Under each token every document is held against one centre; where many are still apart, further passes hold them
against one of the largest component there and one of the rest; the sets of a centre's documents form a compressed trie, which a probe goes through sharing the overlap of common beginnings and leaving subtrees whose remaining
lengths cannot reach the threshold. Only links that join components are kept, of
several between two components one. Documents that still stand in different
components under one token are then held against each other, after a bound on their overlap from their common
tokens; no pair inside a component is ever written out. Equal sets are told by a digest of their shingles' words, links by the words themselves. Tokens of many documents are parted by classes of
length; where many documents stand even in one class, blocks of parity bits (a bit for each residue of the
tokens' hashes, set if an odd number has it) bound the difference of two sets before any set moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, hot_join, hot_keys, slices, staged
from .word_hashes import PRIME, mixed, runs, word_hashes

SIZE = 5
PERCENT = 80
BITS = 44  # of a hash in a token; the rest numbers a text's shingles of one hash
BUCKETS = 20  # bits: shingles are counted in 2**20 buckets, whatever the corpus
BLOCK = 512  # sets in a trie at most
BLOCK_SHINGLES = 2_000_000  # shingles in a trie at most, by the lengths of its sets
FEW_IDS = 500_000  # ids that are broadcast at most
PAIRED = 128  # documents under one token that are paired; more are parted by length, and then dealt to blocks
CROWDED = 4  # pairs still apart for each document of a token, beyond which it gets further centres
TURNS = 6  # passes of further centres at most
CLASS = 1.26  # lengths of a class: sets that link (at most 1.25 times as long) are in one class or in two next to each other


def shingled(texts: list[str | None], bits: int = BITS, spelled: bool = False) -> Iterator[tuple[np.ndarray, Callable[[], list[bytes]]]]:
    """For each text a token for each different shingle (five words in a row, ASCII letters in lower case; all words if they are fewer), and a call that spells them in that order.

    A token is the first `bits` of a hash and, below them, a number among the text's shingles of one such hash, whose words are compared.
    So a set has as many tokens as shingles, and two sets have at least as many common tokens as common shingles, whatever the hash:
    bounds on tokens lose no link, and links are held against the words. `spelled` makes spelling cheaper, if all are spelled.
    """
    if spelled:
        texts = [b" ".join(t.encode().lower().split()) if t else b"" for t in texts]
    h, counts, whole, opens, closes = word_hashes(texts, lower=not spelled)
    every = runs(h, SIZE) if len(h) >= SIZE else np.zeros(0, np.uint64)
    low, at = np.uint64(64 - bits), 0
    plain = (lambda a, b: whole[a:b]) if spelled else (lambda a, b: b" ".join(whole[a:b].split()))
    for n in counts.tolist():
        size = min(n, SIZE)
        own = (every[at : at + n - SIZE + 1] if n >= SIZE else runs(h[at : at + n], n) if n else every[:0]) >> low << low
        order = np.argsort(own)
        own, places = own[order], order + at
        spell = lambda places, size=size: list(map(plain, opens[places].tolist(), closes[places + size - 1].tolist()))
        again = own[1:] == own[:-1]
        if again.any():
            twice = np.append(again, False)
            twice[1:] |= again
            held = places[twice]
            words = dict(zip(zip(own[twice].tolist(), spell(held), strict=True), held.tolist(), strict=True))
            tokens, last, number = [], None, 0
            for first, _ in (in_order := sorted(words)):
                number = number + 1 if first == last else 0
                tokens.append(first + number)
                last = first
                if number >> int(low):
                    raise ValueError(f"more than {1 << int(low)} different shingles under one hash of {bits} bits")
            own = np.concatenate([own[~twice], np.array(tokens, np.uint64)])
            places = np.concatenate([places[~twice], np.array([words[w] for w in in_order], np.int64)])
            order = np.argsort(own)
            own, places = own[order], places[order]
        yield own.view(np.int64), lambda places=places, spell=spell: spell(places)
        at += n


def shingle_sets(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    return [tokens for tokens, _ in shingled(texts, bits)]


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """By class of their bucket, rare ones first, then by hash; the order is the same for all sets."""
    return tokens[np.lexsort([tokens, common[_bucket(tokens)]])]


def prefix_length(n: int) -> int:
    """So many first tokens that a set of n shares one of them with any set that it links with."""
    return n - -(-n * PERCENT // 100) + 1


def signed(docs: DataFrame, bits: int) -> DataFrame:
    """_id, _content, n, digest of the shingles' words; and apart from them (with digests of one byte) the buckets that a task found common, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        names = ["_id", "_content", "n", "digest"]
        for batch in slices(batches, "_text", 1 << 20):
            n, digest, every = [], [], []
            for tokens, spell in shingled(batch.column("_text").to_pylist(), bits, spelled=True):
                every.append(_bucket(tokens))
                n.append(len(tokens))
                # the order of tokens follows from the set of shingles
                digest.append(hashlib.blake2b(b"\n".join(spell()), digest_size=20).digest() if n[-1] else None)
            np.add.at(total, np.concatenate([*every, np.zeros(0, np.int64)]), 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_content"), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], names=names)
        mean = total.mean()
        at = np.flatnonzero(total > mean + 8 * np.sqrt(mean) + 4)
        tag = np.array([-1], np.int64).tobytes()[:1]  # one byte: no digest is that short
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(total[at], pa.int64()), pa.array([tag] * len(at), pa.binary())], names=names)

    return docs.mapInArrow(run, "_id long, _content binary, n long, digest binary")


def _common_classes(marked: DataFrame, total: int) -> np.ndarray:
    """A byte for each bucket: 0, or for common ones the size of their count in bits."""
    mean = total / (1 << BUCKETS)
    least = max(32, mean + 8 * mean**0.5 + 8)
    found = marked.groupBy("_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # at most 2**20 rows
    out = np.zeros(1 << BUCKETS, np.uint8)
    if found.num_rows:
        out[found.column("_id").to_numpy()] = np.ceil(np.log2(found.column("n").to_numpy())).astype(np.uint8)
    return out


class Trie:
    """Ordered sets in a tree whose edges hold runs of tokens; a node knows the lengths and components below it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.root = self._node(order, 0)

    def _node(self, members: list[int], depth: int) -> tuple:
        """(label, depth after it, shortest, longest, members, members that end here, children); members stand in order."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        # members in between share what the first and the last share, but one may end sooner
        end = min(depth + int(differ[0]) if len(differ) else n, min(len(self.sets[i]) for i in members))
        done = [i for i in members if len(self.sets[i]) == end]
        children, group = [], []
        for i in members:
            if len(self.sets[i]) == end:
                continue
            if group and self.sets[group[-1]][end] != self.sets[i][end]:
                children.append(group)
                group = []
            group.append(i)
        if group:
            children.append(group)
        lengths = [len(self.sets[i]) for i in members]
        return first[depth:end], end, min(lengths), max(lengths), members, done, [self._node(c, end) for c in children]

    def alike(self, probe: np.ndarray, wanted) -> Iterator[int]:
        """Members alike to the probe, among subtrees in which wanted(member) holds for any."""
        held = np.sort(probe)
        n = len(held)
        pending = [(self.root, 0)]
        while pending:
            (label, depth, shortest, longest, members, done, children), overlap = pending.pop()
            if len(label):
                at = np.searchsorted(held, label)
                overlap += int((held[np.minimum(at, n - 1)] == label).sum())
            missed = depth - overlap  # tokens of the path that the probe lacks
            # a set below can share all but the missed ones; it must share 80 % of the union
            reach = min(longest - missed, n)
            if reach * (100 + PERCENT) < PERCENT * (n + max(shortest, reach + missed)) or not any(map(wanted, members)):
                continue
            if overlap * 100 >= PERCENT * (n + depth - overlap):
                yield from (i for i in done if wanted(i))
            pending += [(c, overlap) for c in children]


def joining_links(sets: list[np.ndarray], sure: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links that span the components of the sets, each between members alike that are `sure` to be."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links: list[tuple[int, int]] = []
    trie = Trie(sets)
    asked: set[int] = set()
    while True:
        groups: dict[int, list[int]] = {}
        for i in range(len(sets)):
            groups.setdefault(root(i), []).append(i)
        if len(groups) < 2:
            return links
        # a link between groups has an end outside the largest one: only those need to ask
        largest = max(groups, key=lambda g: len(groups[g]))
        rest = [i for g, own in groups.items() if g != largest for i in own if i not in asked]
        if len(groups[largest]) == 1 and not asked:
            rest.insert(0, groups[largest][0])  # all alone yet: the first (the centre) goes first
            rest.sort()
        if not rest:
            return links
        for i in rest:
            asked.add(i)
            mine = root(i)
            before = len(links)
            for j in trie.alike(sets[i], lambda j: root(j) != mine):
                if root(j) != root(i) and sure(i, j):
                    links.append((i, j))
                    parent[root(j)] = root(i)
                    mine = root(i)
            if len(links) > before:
                break  # groups have grown: see anew who needs to ask


def word_shingles(text: str) -> set[bytes]:
    """The text's shingles as words joined by a blank, ASCII letters in lower case."""
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + SIZE]) for k in range(max(1, len(words) - SIZE + 1))} if words else set()


def _links(blocks: DataFrame, by: list[str], table, bits: int) -> DataFrame:
    """a, b: links found in each block of (by.., centre, doc, _text). The trie holds hashes; each link is held against the words themselves."""

    def solve(block: pa.Table) -> pa.Table:
        rows = sorted({(not centre, doc, text) for centre, doc, text in zip(*(block.column(c).to_pylist() for c in ("centre", "doc", "_text")), strict=True)})
        # the centre first; a text that comes as the centre and as a member is one
        seen = dict.fromkeys((doc, text) for _, doc, text in rows)
        every = [ordered(s, table.value) for s in shingle_sets([text for _, text in seen], bits)]
        held = [(doc, text, s) for (doc, text), s in zip(seen, every, strict=True) if len(s)]
        true: dict[int, set[bytes]] = {}

        def sure(i: int, j: int) -> bool:
            for k in (i, j):
                if k not in true:
                    true[k] = word_shingles(held[k][1])
            both = len(true[i] & true[j])
            return both * 100 >= PERCENT * (len(true[i]) + len(true[j]) - both)

        found = joining_links([s for *_, s in held], sure) if held else []
        return pa.table({"a": pa.array([held[i][0] for i, _ in found], pa.int64()), "b": pa.array([held[j][0] for _, j in found], pa.int64())})

    return blocks.groupBy(*by).applyInArrow(solve, "a long, b long")


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each residue of the tokens' hashes, set if an odd number of them has it; four to eight bits for each token, 64 at least."""
    bits = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    residues = mixed(tokens.view(np.uint64) * PRIME).view(np.int64) & (bits - 1)
    return np.packbits(np.bincount(residues, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(held: bytes, size: int) -> np.ndarray:
    """Parities of fewer residues: halves laid over each other."""
    words = np.frombuffer(held, np.uint64)
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def close_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """doc, doc2 (the larger) and the latter's n: what the parities of a block (doc, n, component, home, chunk, bits) leave of its pairs.

    Sets that link differ in at most a ninth of their lengths' sum, and parities never differ in more bits than
    sets in tokens. Pairs are of two components, one at least at home in the class, and of two chunks if there are two.
    """
    pdf = pdf.drop_duplicates(["doc", "bits"])
    doc, n, component, home, chunk = (pdf[c].to_numpy() for c in ("doc", "n", "component", "home", "chunk"))
    size = min(map(len, pdf["bits"])) // 8
    bits = np.stack([_folded(b, size) for b in pdf["bits"]])
    apart = pdf["chunk"].nunique() > 1
    a, b, size2 = [], [], []
    for i in range(len(doc) - 1):
        rest = slice(i + 1, None)
        on = (component[rest] != component[i]) & (home[rest] | home[i]) & (doc[rest] != doc[i])
        on &= np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * PERCENT
        if apart:
            on &= chunk[rest] != chunk[i]
        j = i + 1 + np.flatnonzero(on)
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
        j = j[differ * (100 + PERCENT) <= (100 - PERCENT) * (n[j] + n[i])]
        a.append(np.minimum(doc[j], doc[i])), b.append(np.maximum(doc[j], doc[i])), size2.append(np.where(doc[j] > doc[i], n[j], n[i]))
    return pd.DataFrame({"doc": np.concatenate([*a, []]), "doc2": np.concatenate([*b, []]), "n2": np.concatenate([*size2, []])}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """doc, component (the smallest id reachable) of the ends of links (a, b): stars are passed on to ever smaller centres."""
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large stars: larger neighbours of a node go to its smallest neighbour
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = staged(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n")), "least")
        met = hot_join(both, least.drop("n"), ["x"], hot_keys(least, ["x"]), by="y")
        large = staged(met.where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct(), "edges")
        # small stars: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionAll(low.select("v", F.col("m").alias("u"))).distinct()
        before, edges = edges, staged(small.select("u", "v"), "edges")
        discard(before, least, large)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("doc"), "component").unionAll(edges.select(F.col("u").alias("doc"), F.col("u").alias("component")).distinct())


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """components() of what made `joined` (doc, component) and further links: ends stand for their components, so that of all links between two of them one moves on."""
    end = lambda rows, c: rows.join(joined.select(F.col("doc").alias(c), F.col("component").alias("_of")), c, "left").withColumn(c, F.coalesce("_of", c)).drop("_of")
    over = end(end(links.distinct(), "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = staged(components(over.distinct()), "merged")
    new = more.select(F.col("doc").alias("component"), F.col("component").alias("_new"))
    return joined.join(new, "component", "left").select("doc", F.coalesce("_new", "component").alias("component")).unionAll(more.join(joined, "doc", "left_anti").select("doc", "component"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links of similarity 80 % or more) of every row.

    Sets are of five-word shingles; a text of fewer words is one shingle, an empty or null one has none and links with
    nothing. Ids are whole numbers; a row with a null id links with nothing and has a null component. Rows of
    one id with different texts get the component of their own text; links of either reach the id. An empty table gives no rows; further
    columns are left out. Shingles are counted, and links and equal sets told, by their words; `bits` of their hashes
    only decide what meets, and any number gives the same rows (more than 2**(64 - bits) different shingles of one text under one hash are an error).
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_content"))
    made = staged(signed(rows, bits), "signed")
    every = made.where(F.col("digest").isNull() | (F.length("digest") > 1))
    common = _common_classes(made.where(F.length("digest") == 1), every.agg(F.sum("n")).first()[0] or 0)
    table = docs.sparkSession.sparkContext.broadcast(common)
    named = every.where(F.col("_id").isNotNull() & F.col("digest").isNotNull())
    # one document stands for all of an equal set
    first = F.min(F.struct("_id", "_content")).alias("f")
    firsts = staged(named.groupBy("digest").agg(first, F.first("n").alias("n"), F.count("*").alias("copies")).select("digest", "f.*", "n", "copies"), "firsts")

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            sets = shingle_sets(batch.column("_text").to_pylist(), bits)
            tokens = [ordered(s, table.value)[: prefix_length(len(s))].tolist() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_content"), pa.array(tokens, pa.list_(pa.int64()))], names=["_id", "_content", "tokens"])

    prefixes = rows.where(F.col("_id").isNotNull() & F.col("_text").isNotNull()).mapInArrow(first_tokens, "_id long, _content binary, tokens array<bigint>").where(F.size("tokens") > 0)
    prefixes = staged(prefixes.join(firsts.select("_id", "_content", "n"), ["_id", "_content"]).select(F.col("_id").alias("doc"), "n", "tokens"), "prefixes")
    shared = staged(prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "tokens")
    busy = staged(hot_keys(shared, ["token"], "size"), "busy")
    posts = staged(hot_join(prefixes.select("doc", "n", F.explode("tokens").alias("token")), shared.select("token"), ["token"], busy, by="doc"), "posts")
    discard(prefixes)
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT

    def can_reach(k, n, m):
        """Whether sets of n and m tokens with k common ones in their prefixes can link: up to the end of the prefix that ends first all
        other tokens differ, so the overlap is at most k and what the set of that prefix has beyond it."""
        beyond = lambda size: F.ceil(size * PERCENT / 100) - 1
        return (k + F.greatest(beyond(n), beyond(m))) * (100 + PERCENT) >= (n + m) * PERCENT

    def texts_of(wanted: DataFrame) -> DataFrame:
        """doc and _text of the ids in wanted (doc)."""
        ids = wanted.select(F.col("doc").alias("_id")).distinct()
        if wanted.count() <= FEW_IDS:  # at most 4 MB: texts need not move; beyond that they are joined
            ids = F.broadcast(ids)
        return rows.join(ids, "_id").where(F.col("_text").isNotNull()).select(F.col("_id").alias("doc"), "_text")

    def parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            held = [parities(s) for s in shingle_sets(batch.column("_text").to_pylist(), bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(held, pa.binary())], names=["doc", "bits"])

    def held_against(pairs: DataFrame) -> DataFrame:
        """Links among the documents of each centre, in blocks of about BLOCK sets or BLOCK_SHINGLES shingles; pairs: centre, doc and the latter's n."""
        most = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
        sizes = staged(pairs.groupBy("centre").agg(F.ceil(most).cast("int").alias("parts"), F.count("*").alias("size")), "sizes")
        members = hot_join(pairs, sizes.drop("size"), ["centre"], hot_keys(sizes, ["centre"], "size"), by="doc").select("centre", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
        centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("doc"))
        members = staged(members.unionAll(centres), "members")
        blocks = texts_of(members).join(members, "doc").select(F.col("centre").alias("block"), "part", (F.col("centre") == F.col("doc")).alias("centre"), "doc", "_text")
        links = staged(_links(blocks, ["block", "part"], table, bits), "links")
        discard(pairs, sizes, members)
        return links

    centres = staged(posts.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("c")).select("token", F.col("c.doc").alias("centre"), F.col("c.n").alias("m")), "centres")
    # a first pass that joins most of what is alike; whatever it leaves out (such as tokens with another centre) comes after it
    stars = hot_join(posts, centres, ["token"], busy, by="doc").where((F.col("doc") != F.col("centre")) & fits(F.col("n"), F.col("m")))
    stars = stars.groupBy("doc", "centre", "n", "m").agg(F.count("*").alias("k")).where(can_reach(F.col("k"), F.col("n"), F.col("m"))).select("centre", "doc", "n")
    links = held_against(staged(stars, "stars"))
    joined = staged(components(links), "components")
    discard(centres, links)

    def apart(rows: DataFrame) -> DataFrame:
        """token, doc, n, component and size of what stands under one token in more than one component."""
        placed = staged(rows.select("token", "doc", "n").join(joined, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
        open_tokens = staged(placed.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token", "size"), "open")
        left = staged(hot_join(placed, open_tokens, ["token"], busy, by="doc"), "left")
        discard(rows, placed, open_tokens)
        return left

    class_of = lambda n: F.floor(F.log(n) / F.lit(float(np.log(CLASS)))).cast("int")
    # further passes under crowded tokens: documents meet one of the token's largest component, and one of those outside it in their own class of length, both chosen by a
    # hash of the pass's own. A first centre may be alike to none of a large group, which would then be paired with itself below. Passes end when no token is crowded or the
    # last one took less than a quarter of the pairs away; what is left is examined below.
    left, before = apart(posts), None
    for turn in range(TURNS):
        pick = F.min(F.struct(F.xxhash64(F.lit(turn), "doc").alias("h"), "doc", "n")).alias("pick")
        groups = staged(left.groupBy("token", class_of("n").alias("class"), "component").agg(F.count("*").alias("docs"), pick), "groups")
        crowds = groups.groupBy("token", "component").agg(F.sum("docs").cast("double").alias("docs"), F.min("pick").alias("pick")).groupBy("token")
        crowds = crowds.agg(F.sum("docs").alias("size"), F.sum(F.col("docs") ** 2).alias("within"), F.max(F.struct("docs", "component", "pick")).alias("core"))
        crowds = staged(crowds.withColumn("pairs", (F.col("size") ** 2 - F.col("within")) / 2).where(F.col("pairs") > CROWDED * F.col("size")), "crowds")
        pairs = crowds.agg(F.sum("pairs")).first()[0]
        if not pairs or (before and pairs > 0.75 * before):
            discard(groups, crowds)
            break
        before = pairs
        other = F.min(F.when(F.col("component") != F.col("core.component"), F.struct("pick", "component"))).alias("other")
        cores = groups.join(crowds.select("token", "core"), "token").groupBy("token", "class").agg(F.sum("docs").alias("docs"), F.first("core").alias("core"), other)
        cores = staged(cores, "cores")
        met = hot_join(left.drop("size").withColumn("class", class_of("n")), cores, ["token", "class"], hot_keys(cores, ["token", "class"], "docs"), by="doc")
        centre = lambda c: F.struct(F.col(f"{c}.pick.doc").alias("centre"), F.col(f"{c}.pick.n").alias("m"), F.col(f"{c}.component").alias("of"))
        near = F.filter(F.array(centre("core"), centre("other")), lambda c: (c["of"] != F.col("component")) & fits(F.col("n"), c["m"]))
        again = met.select("doc", "n", F.explode(near).alias("c")).select("doc", "n", "c.centre", "c.m").groupBy("doc", "centre", "n", "m").agg(F.count("*").alias("k"))
        links = held_against(staged(again.where(can_reach(F.col("k"), F.col("n"), F.col("m"))).select("centre", "doc", "n"), "stars"))
        old, joined = joined, staged(merged(joined, links), "components")
        discard(old, groups, crowds, cores, links)
        left = apart(left)
    # all that is still apart
    here = class_of("n")
    # each document of a large token is at home in its own class and a guest in the next one
    parted = left.where(F.col("size") > PAIRED).drop("size").withColumn("class", F.explode(F.array(here, here + 1))).withColumn("home", F.col("class") == here)
    sizes = parted.groupBy("token", "class").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).where("homes > 0").drop("homes")
    sizes = staged(sizes, "sizes")
    parted = staged(hot_join(parted, sizes, ["token", "class"], hot_keys(sizes, ["token", "class"], "size"), by="doc"), "parted")
    discard(sizes)
    few = left.where(F.col("size") <= PAIRED).select("token", F.lit(0).alias("class"), "doc", "n", "component", F.lit(True).alias("home"))
    few = few.unionAll(parted.where(F.col("size") <= PAIRED).select(few.columns))
    other = few.select("token", "class", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "component", "home")])
    met = few.join(other, ["token", "class"]).where((F.col("doc") < F.col("doc2")) & (F.col("component") != F.col("component2")) & (F.col("home") | F.col("home2")) & fits(F.col("n"), F.col("n2")))
    # all common tokens of such a pair are among these, unless it meets in a large group below
    met = met.groupBy("doc", "doc2", "n", "n2").agg(F.count("*").alias("k"))
    likely = met.where(can_reach(F.col("k"), F.col("n"), F.col("n2"))).select("doc", "doc2", "n2")
    # large groups: their documents in chunks, each two chunks in a block
    chunks = F.ceil(F.col("size") * 2 / BLOCK).cast("int")
    dealt = parted.where(F.col("size") > PAIRED).withColumn("chunk", F.pmod(F.xxhash64("doc"), chunks).cast("int"))
    blocks = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1))).select("token", "class", F.least("chunk", "with").alias("part"), F.greatest("chunk", "with").alias("part2"), "doc", "n", "component", "home", "chunk")
    odd = texts_of(dealt.select("doc")).mapInArrow(parity_rows, "doc long, bits binary")
    close = odd.join(staged(blocks, "blocks"), "doc").groupBy("token", "class", "part", "part2").applyInPandas(close_pairs, "doc long, doc2 long, n2 long")
    likely = staged(likely.unionAll(close).groupBy("doc", "doc2").agg(F.max("n2").alias("n")).select(F.col("doc").alias("centre"), F.col("doc2").alias("doc"), "n"), "likely")
    discard(left, parted)
    more = held_against(likely)
    joined = merged(joined, more)
    named_sets = firsts.join(joined, firsts["_id"] == joined["doc"], "left").select("digest", "copies", F.coalesce("component", "_id").alias("component_id"))
    named_sets = staged(named_sets, "classes")
    discard(firsts, more)
    return hot_join(every, named_sets.drop("copies"), ["digest"], hot_keys(named_sets, ["digest"], "copies"), by="_id", how="left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "_id")).cast("long").alias("component_id"))
