"""What one kind of task keeps in a worker goes when the next kind begins, and large arrays go back to the system."""

import gc
import os
import subprocess
import sys
import weakref

import pyarrow as pa

from kinlink.llm import packing
from kinlink.llm.queries import tokenizer_path
from kinlink.llm.seqhash import chunks


def test_token_cache_goes_with_the_next_operator():
    words = packing.word_ids(tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["a text"])], ["doc_id", "text"])
    assert len(list(chunks([batch], own=("words", tokenizer_path())))) == 1
    assert packing.word_ids(tokenizer_path()) is words
    gone = weakref.ref(words)
    del words
    assert len(list(chunks([batch]))) == 1
    gc.collect()
    assert gone() is None


GROW = """
import numpy as np
from kinlink.llm.worker import lean
lean()
def held():
    return int(next(x for x in open('/proc/self/status') if x.startswith('RssAnon')).split()[1]) // 1024
before = held()
small = []
for _ in range(20):
    big = [np.ones(1 << 18) for _ in range(40)]
    small.append(bytearray(2000))
    big.append(bytearray(900))
    del big
    small.append(bytearray(70000))
print(held() - before)
"""


def test_freed_arrays_are_not_held():
    path = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", GROW], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": path})
    assert int(out.stdout) < 30
