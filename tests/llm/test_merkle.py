import hashlib
import zlib

from linkloom.llm import merkle as M


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def route(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i // 8 * 8:i // 8 * 8 + 8], i % 8))
        i //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, from whole trees."""
    if not rows:
        return []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = {}
    for r in rows:
        of.setdefault(r[2], []).append(r)
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        of[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = levels([leaf(r, r[1]) for r in of[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(of[lang]):
            way = route(trees[lang], i) + route(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[1].translate(low) if hit and r[1] is not None else r[1])
            for run, slot in way:
                now = digest("".join(run[:slot]) + now + "".join(run[slot + 1:]))
            proof = digest("".join(x for run, slot in way for j, x in enumerate(run) if j != slot))
            out.append((r[0], trees[lang][0][i], trees[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def test_manifest_equals_brute_force_on_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(M.manifest(odd_docs)) == brute(odd_rows)
    assert M.manifest(no_docs).count() == 0


def test_many_tiers_and_single_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"Text {i % 7}", "en", "a", i) for i in range(700)] + [(1000 + i, None, f"l{i}", None, None) for i in range(70)]
    rows += [(5000 + i, "UPPER", None, "s", 1) for i in range(9)] + [(6000, "same", "dup", "s", 1)] * 65
    one = spark.createDataFrame(rows, schema).repartition(5)
    assert got(M.manifest(one, tier_levels=1)) == brute(rows)  # tiers of eight in place of 4 096
    assert got(M.manifest(one.filter("lang = 'l3'"))) == brute([r for r in rows if r[2] == "l3"])


def test_folding_takes_up_right_siblings_only():
    nodes = [digest(str(i)) for i in range(70)]
    sub = M.Subtree(nodes, 3)
    tree = levels(nodes)
    assert sub.root == tree[-1][0]
    for i in (0, 7, 8, 63, 64, 69):
        assert sub.fold(i, nodes[i])[0] == sub.root
        want = digest("new")
        for run, slot in route(tree, i):
            want = digest("".join(run[:slot]) + want + "".join(run[slot + 1:]))
        assert sub.fold(i, digest("new"))[0] == want
        assert ["".join(x for j, x in enumerate(run) if j != slot) for run, slot in route(tree, i)] == sub.fold(i, nodes[i])[1]
        assert M.Path(M.Path.pack(sub.siblings(i))).fold(digest("new"), hashlib.sha256()) == want
