import hashlib
import zlib

from goldsieve.llm import merkle
from goldsieve.llm.merkle import PersistentTree, fold, joint, merkle_manifest, proof_digest


def _leaf(row):
    parts = ["-" if value is None else f"{len(str(value).encode())}:{value}" for value in row]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climb(level):
    """All levels of a tree."""
    levels = [level]
    while len(level) > 1:
        level = [joint(level[at : at + 8]) for at in range(0, len(level), 8)]
        levels.append(level)
    return levels


def _lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _brute(rows):
    """Whole trees; every tampered leaf rebuilds its tree and the root."""
    trees = {}
    for row in rows:
        trees.setdefault(b"" if row[2] is None else b"=" + row[2].encode(), []).append(row)
    names = sorted(trees)
    for name in names:
        trees[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, _leaf(row)))
    levels = {name: _climb([_leaf(row) for row in trees[name]]) for name in names}
    tops = _climb([levels[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for place, row in enumerate(trees[name]):
            near = []
            for tree, at in ((levels[name], place), (tops, number)):
                for level in tree[:-1]:
                    run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(level)))
                    near += [level[other] for other in run if other != at]
                    at //= 8
            leaves = list(levels[name][0])
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                leaves[place] = _leaf((*row[:4], _lowered(row[4])))
            subroots = [_climb(leaves)[-1][0] if other == name else levels[other][-1][0] for other in names]
            folded, root = _climb(subroots)[-1][0], tops[-1][0]
            proof = hashlib.sha256("".join(near).encode()).hexdigest()
            out.append((row[0], levels[name][0][place], levels[name][-1][0], root, proof, folded, folded == root))
    return out


def _check(docs):
    rows = [tuple(row) for row in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = merkle_manifest(docs)
    found = found.withColumn("proof", proof_digest(found["proof"]))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, _brute(rows)))


def _docs(spark, rows):
    full = [(key, text, lang, "Src", None if text is None else len(text)) for key, text, lang in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_versions_share_untouched_nodes():
    leaves = [joint([str(n)]) for n in range(300)]
    tree = PersistentTree(leaves)
    before, digests = len(tree.digest), list(tree.digest)
    top = tree.version(77, joint(["new"]))
    assert len(tree.digest) - before == 1 + tree.levels
    assert tree.digest[:before] == digests
    changed = leaves[:77] + [joint(["new"])] + leaves[78:]
    assert tree.digest[top] == _climb(changed)[-1][0] == fold(joint(["new"]), tree.path(77))
    # A version of a version keeps both changes; the first tree is as it was.
    later = tree.version(299, joint(["last"]), top)
    assert tree.digest[later] == _climb(changed[:299] + [joint(["last"])])[-1][0]
    assert tree.digest[tree.top] == _climb(leaves)[-1][0]
    assert fold(leaves[77], tree.path(77)) == tree.digest[tree.top]


def test_many_blocks(spark, monkeypatch):
    """Small blocks make trees of several levels of blocks; last blocks have one node."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(n, f"Text {n % 50}" if n % 9 else None, "en" if n % 3 else "de") for n in range(195)]
    rows += [(1000 + n, "ä" * n, f"l{n}") for n in range(9)]
    _check(_docs(spark, rows))


def test_odd_rows(spark, odd_docs):
    _check(odd_docs)
    rows = [(None, "A", None), (None, None, None), (3, "", ""), (3, None, ""), (5, "Twice", "en"), (5, "Twice", "en")]
    _check(_docs(spark, rows))
    _check(_docs(spark, [(1, "One Leaf", "en")]))


def test_none_and_clashing_columns(spark):
    docs = _docs(spark, [(n, "Some Text", "en") for n in range(20)])
    assert merkle_manifest(docs.where("false")).count() == 0
    more = docs.selectExpr("*", "1 AS tree", "2 AS place", "3 AS digest", "4 AS root", "5 AS row_no", "6 AS n")
    assert sorted(map(repr, merkle_manifest(more).collect())) == sorted(map(repr, merkle_manifest(docs).collect()))
