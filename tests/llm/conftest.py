import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventloom.session import ship

WORDS = (
    "river stone market winter garden letter bridge music paper window castle forest teacher island summer "
    "kitchen doctor flower yellow silver thunder village machine harbour painter quarter shadow mirror"
).split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def write(folder, name, columns):
    pq.write_table(pa.table(columns), os.path.join(folder, f"{name}.parquet"))


def tables(folder, documents, labels=((), (), ()), benchmark=((), ()), vectors=((), ()), pages=((), (), ())):
    """The tables the queries read; each argument is a tuple of columns."""
    ids, texts, langs, sources = documents
    text = pa.string()
    write(folder, "documents", {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, text), "lang": pa.array(langs, text),
        "source": pa.array(sources, text), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        # names that operators might use themselves
        **{c: pa.array([c] * len(ids), text) for c in ("_row_", "row", "size", "f", "v", "score", "toxic", "_id", "bucket", "a.b")},
    })
    write(folder, "labels", {
        "doc_id": pa.array(labels[0], pa.int64()), "quality": pa.array(labels[1], pa.int32()), "toxic": pa.array(labels[2], pa.int32()),
    })
    write(folder, "benchmark", {"item_id": pa.array(benchmark[0], pa.int64()), "text": pa.array(benchmark[1], text)})
    write(folder, "embeddings", {
        "vec_id": pa.array(vectors[0], pa.int64()), "embedding": pa.array(vectors[1], pa.list_(pa.float32())),
        "label": pa.array([None] * len(vectors[0]), pa.int32()),
    })
    write(folder, "pages", {
        "page_id": pa.array(pages[0], pa.int64()), "url": pa.array(pages[1], text), "html": pa.array(pages[2], text),
    })
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), ((), (), (), ()))


@pytest.fixture(scope="session")
def odd_documents():
    """Null, blank and very long texts, copies, near copies, repeated rows, null
    ids, sources and languages."""
    long_text = prose(1, 30_000)
    near = long_text.split()
    near[777] = "changed"
    texts = [None, "", " \n\t", long_text, long_text, " ".join(near), "one", "one", "éè \U0001f600 　 x"]
    texts += [prose(i, 20 + i) for i in range(10, 60)]
    ids = list(range(len(texts)))
    ids += [12, 12, None]
    texts += [texts[12], texts[12], prose(99, 40)]
    sources = ["hot" if i % 3 else ("a", "b", None)[i % 9 // 3] for i in range(len(ids))]
    langs = [("en", "de", None)[i % 3] for i in range(len(ids))]
    return ids, texts, langs, sources


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory, odd_documents):
    ids, texts, _, _ = odd_documents
    draw = np.random.default_rng(3)
    vectors = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [1.0, 2.0], []]
    vectors += [draw.normal(size=4).tolist() for _ in range(20)]
    vectors += [vectors[10]] * 3
    item = " ".join(texts[30].split()[:12])
    return tables(
        tmp_path_factory.mktemp("odd"),
        odd_documents,
        labels=([0, 10, 11, 12, 12, None, 13], [1, 0, 1, None, 1, 0, 1], [0, 1, 0, 0, None, 1, 0]),
        benchmark=([1, 2, 3, None, 4], [item, None, "", item, item]),
        vectors=(list(range(len(vectors))), vectors),
        pages=([1, 2, 3, None], ["u", None, "u", "u"], [None, "", "<p>Hello, world.</p>" * 3, "<nav>x</nav"]),
    )
