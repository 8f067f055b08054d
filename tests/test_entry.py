"""The entry stands without the training-data operations."""

import subprocess
import sys


def test_entry_without_the_optional_parts():
    code = (
        "import sys\n"
        "for name in sys.argv[1:]: sys.modules[name] = None\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(q.startswith('op') for q in e.queries()))\n"
    )
    for missing in ("redpen.llm", "corpus_pipeline", "public_tokenizers"):
        out = subprocess.run([sys.executable, "-c", code, missing], capture_output=True, text=True, check=True)
        assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 84
