"""Memory of workers on inputs that are large in one way only: many short texts, long unbroken strings."""

import random
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pyarrow as pa

from lorebank.llm import bpe, language_id, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

SHORT = """
import resource, numpy as np, pyarrow as pa
from lorebank.llm import language_id as L
class Shipped:
    value = {"languages": ["a"], "idf": np.ones(L.DIM, np.float32), "centroids": np.ones((3, L.DIM), np.float32), "of": np.zeros(3, np.int64), "reject": np.zeros((1, len(L.LENGTHS)))}
batch = pa.record_batch([pa.array(range(10000)), pa.array(["ab cd"] * 10000)], ["doc_id", "__text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(len(b) for b in L._predicted(Shipped)([batch])) == 10000
assert sum(len(b) for b in L._sampled([pa.record_batch([pa.array(["a"] * 10000), pa.array(["ab cd"] * 10000)], ["lang", "text"])])) == 10000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_many_short_texts_take_little_memory():
    out = subprocess.run([sys.executable, "-c", SHORT], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout.split()[-1]) < 150


def test_long_unbroken_strings_are_not_remembered():
    texts = [("x" * 50 + chr(97 + i % 26)) * 2000 + str(i) for i in range(30)]
    coder = bpe.Encoder(bpe.Model(VOCABULARY))
    first = list(coder.encode_all([*texts, "a few words"]))
    assert list(coder.encode_all(["a few words", *texts[::-1]])) == [first[-1], *first[-2::-1]]
    list(coder.encode_all(["a few words"]))
    assert max(map(len, coder.ids)) <= bpe.KEPT
    model = bpe.Model(public_tokenizers.path("byte_bpe_50k.json"))
    model.proven = token_counts.shortcuts(model)
    counter = token_counts.Counter(model)
    n = counter.count_all(texts)
    assert counter.count_all(texts[::-1]) == n[::-1] and max(map(len, counter.known)) <= max(bpe.KEPT, max(map(len, counter.one)))


ENCODED = """
import pickle, random, resource, sys, pyarrow as pa
from lorebank.llm import bpe
coder = bpe.Encoder(pickle.loads(pickle.dumps(bpe.Model(sys.argv[1]))))
rng, most = random.Random(1), 0
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in range(6):
    batch = pa.array([" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(2000)) for _ in range(40)])
    for some in bpe.together(batch):
        list(coder.encode_all(some))
        most = max(most, len(coder.ids))
print(most, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_an_encoder_of_ever_new_words_takes_little_memory():
    out = subprocess.run([sys.executable, "-c", ENCODED, VOCABULARY], capture_output=True, text=True, check=True, timeout=300)
    words, most = map(int, out.stdout.split()[-2:])
    assert words <= 1.1 * bpe.ENCODED and most < 90, out.stdout


def test_learning_is_the_same_as_on_the_driver():
    """Centroids of one language, fitted in a task, against the same steps by hand."""
    texts = [f"der die das {i} und noch {'viele' if i % 2 else 'wenige'} worte mehr davon" for i in range(40)]
    (batch,) = language_id._sampled([pa.record_batch([pa.array(["de"] * 40), pa.array(texts)], ["lang", "text"])])
    idf = np.linspace(1, 2, language_id.DIM, dtype=np.float32)
    got = language_id._fitted(idf)(pa.Table.from_batches([batch])).to_pylist()[0]
    rows = sorted(batch.to_pylist(), key=lambda r: (r["at"], r["tf"]))
    v = language_id.vectors(language_id._dense(rows), idf)
    assert np.frombuffer(got["centroids"], np.float32).reshape(-1, language_id.DIM).tolist() == language_id.clustered(v, language_id.CENTROIDS).astype(np.float32).tolist()
    assert got["reject"] == language_id.thresholds(rows, v, idf).tolist()


PARTED = """
import random, resource, pickle, numpy as np, pyarrow as pa
from lorebank.llm import decontamination as D
from lorebank.llm.bytes_np import Vocabulary
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300000)]
items = [(i, " ".join(rng.choice(words) for _ in range(1000))) for i in range(D.PART // 7000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
windows = D.Windows(items, 10)
vocabulary = Vocabulary(windows.terms)
class Shipped:
    value = vocabulary
docs = pa.record_batch([pa.array(range(300)), pa.array([" ".join(rng.choice(words) for _ in range(900)) + " " + items[i][1][:200] for i in range(300)])], ["doc_id", "text"])
shards = list(D._index(Shipped)([docs]))
class Sent:
    value = (windows.numbered(vocabulary), np.full(len(vocabulary.codes), 5), 2)
rows = [b for b in D._match(Sent)(iter(shards))]
assert sum(len(b) for b in rows) == 300 and min(x for b in rows for x in b.column("n_hit").to_pylist()) > 10
print(len(windows.at) - 1, len(pickle.dumps(Sent.value)) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_the_largest_part_of_test_texts_takes_little_memory():
    out = subprocess.run([sys.executable, "-c", PARTED], capture_output=True, text=True, check=True, timeout=600)
    windows, sent, most = map(int, out.stdout.split()[-3:])
    assert windows > 1_000_000 and sent < 100, out.stdout
    assert most < 600, out.stdout  # the driver's part, which makes the windows, and a worker's, which reads them, in one process


def test_merging_words_together_takes_a_fraction_of_merging_each():
    """CPU time of new words, of all lengths up to and beyond the matrices' widths, against the plain merge of each."""
    rng = random.Random(3)
    parts = "en er de the tion and ing ß ü ñ é keit that ly ble wh qu eau que la ge ver ción los".split()
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        model = bpe.Model(public_tokenizers.path(name))
        words = sorted({"".join(rng.choices(parts, k=rng.randint(2, 5))).encode() for _ in range(30_000)})
        odd = [b"", b"e", *(b"the" * n for n in range(1, 20)), *(rng.randbytes(n) for n in range(60) for _ in range(20))]
        model.merge_many(odd)
        t = time.process_time()
        flat, count = model.merge_many(words)
        many = time.process_time() - t
        t = time.process_time()
        each = [model.merge(w) for w in words]
        one = time.process_time() - t
        assert count.tolist() == list(map(len, each)) and flat.tolist() == [i for ids in each for i in ids]
        flat, count = model.merge_many(odd)
        assert count.tolist() == [len(model.merge(w)) for w in odd] and flat.tolist() == [i for w in odd for i in model.merge(w)]
        assert many < 0.22 * one, (many, one)
