"""A task has one core: encoding starts no threads."""

import os
import subprocess
import sys

CODE = """
import os
from partloom.llm.packing import Encoder
from partloom.llm.queries import TOKENIZER
threads = lambda: len(os.listdir("/proc/self/task"))
encoder = Encoder(TOKENIZER)
before = threads()
encoder.encode([" ".join(f"word{i}" for i in range(20_000))])
print(threads() - before)
"""


def test_encoding_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    ran = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, check=True)
    assert int(ran.stdout) == 0
