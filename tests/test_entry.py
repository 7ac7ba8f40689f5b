import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHUT = """
import sys
class Shut:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Shut())
sys.path.insert(0, {1!r})
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(q.startswith("op") for q in e.queries()))
"""


def run(missing):
    return subprocess.run([sys.executable, "-c", SHUT.format(missing, str(ROOT))],
                          capture_output=True, text=True)


@pytest.mark.parametrize("missing", ["tiktoken", "sentencepiece", "ahocorasick", "public_tokenizers",
                                     "verdara.llm", "corpus_pipeline"])
def test_other_queries_stay_without_the_corpus_packages(missing):
    out = run(missing)
    assert out.returncode == 0, out.stderr
    n, twins, corpus = out.stdout.split()
    assert int(n) >= 89 and int(twins) >= 84 and corpus == "False"


def test_a_missing_module_of_the_library_is_an_error():
    assert run("verdara.operators.spread").returncode != 0
