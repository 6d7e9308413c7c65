"""Sibling licences, whole licence texts and the pruning of paragraphs (operator 5)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses


def gnu(name, what="program", version="3"):
    return (
        f"/*\n * This {what} is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {name}General Public License as published by\n * the Free Software Foundation, either version {version} of the License, or\n * (at your option) any later version.\n *\n"
        f" * This {what} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n *\n * You should have received a copy of the GNU {name}General Public License\n * along with this {what}.  If not, see <https://www.gnu.org/licenses/>.\n */\nint main() {{}}\n"
    )


CASES = [
    (gnu(""), ["GPL"]), (gnu("Lesser ", "library", "2.1"), ["LGPL"]), (gnu("Affero "), ["AGPL"]), ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL"]), ("Licensed under the GNU GPL version 2 or later.", ["GPL"]),
    ("You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.", ["GPL"]),
    ("Licensed under CC BY-SA 4.0.", ["CC BY-SA"]), ("Licensed under CC BY 4.0.", ["CC BY"]), ("Licensed under CC BY-NC 4.0.", ["CC BY-NC"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC BY-SA"]), ("This work is licensed under a\nCreative Commons Attribution 4.0 International License.", ["CC BY"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC BY-NC"]),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.', ["MIT"]),
    ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\nFOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL\nDAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR\nSERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER\nCAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,\nOR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE\nOF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', ["BSD"]),
    ("  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.  By contrast,\nthe GNU General Public License is intended to guarantee your freedom to\nshare and change all versions of a program--to make sure it remains free\nsoftware for all its users.", ["GPL"]),
    ("2. Grant of Copyright License. Subject to the terms and conditions of\nthis License, each Contributor hereby grants to You a perpetual,\nworldwide, non-exclusive, no-charge, royalty-free, irrevocable\ncopyright license to reproduce, prepare Derivative Works of,\npublicly display, publicly perform, sublicense, and distribute the\nWork and such Derivative Works in Source or Object form.", ["Apache"]),
    ("# SPDX-License-Identifier: MIT\nprint(1)", ["MIT"]), ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL"]), ("/* SPDX-License-Identifier: LGPL-2.1-only */", ["LGPL"]), ("SPDX-License-Identifier: Apache-2.0", ["Apache"]), ("SPDX-License-Identifier: CC-BY-SA-4.0", ["CC BY-SA"]),
    ("This is licensed under apache 2.0", ["Apache"]), ("The code is dual licensed under the MIT License and the GNU General Public License.", ["GPL", "MIT"]),
    ("He was under the impression that the public licence of the general was lost.", []), ("The MIT team published a paper on software under the general terms of the grant.", []), ("All rights reserved.", []), ("She got a license to fish, for free, from the foundation of the town.", []),
]


def test_siblings_and_texts(spark, docs):
    df = spark.createDataFrame([(10_000 + i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").unionByName(docs.where("doc_id < 40").select("doc_id", "text"))
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(df).collect()}
    wrong = {t[:60]: (got[10_000 + i], f) for i, (t, f) in enumerate(CASES) if got[10_000 + i] != f}
    assert not wrong


def test_no_paragraph_that_counts_is_left_out(spark, docs, monkeypatch):
    """The scan of the paragraphs with a telling word finds what the scan of all paragraphs does."""
    df = spark.createDataFrame([(10_000 + i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").unionByName(docs.where("doc_id < 120").select("doc_id", "text"))
    some = sorted(map(tuple, licenses.scan(df).drop("best_probability").collect()), key=repr)
    monkeypatch.setattr(licenses, "telling_words", lambda listed: None)
    assert sorted(map(tuple, licenses.scan(df).drop("best_probability").collect()), key=repr) == some


def test_telling_words(spark):
    listed = [r["wanted"] for r in licenses.template_pairs(spark).collect()]
    words = set(licenses.telling_words(listed))
    rnd = random.Random(5)
    for wanted in listed:
        need = math.ceil(licenses.CONFIRM * len(wanted))
        least = sorted(wanted, key=lambda p: bool(words & set(p.split(" "))))[:need]  # as few pairs with such a word as can be
        for chosen in (least, rnd.sample(wanted, need)):
            assert words & {w for p in chosen for w in p.split(" ")}
    assert len(words) < 150 and not words & {"the", "of", "and", "to", "in", "a", "is"}
    texts = licenses.templates(spark).select(licenses.tokens(F.col("text")).alias("w"))
    assert all(words & set(r["w"]) for r in texts.collect())


def test_own_pairs_tell_siblings(spark):
    own = {}
    for r in licenses.template_pairs(spark).collect():
        own.setdefault(r["t_family"], []).append(set(r["own"]))
    assert "gnu general" in set.union(*own["GPL"]) and "gnu affero" in set.union(*own["AGPL"]) and "gnu lesser" in set.union(*own["LGPL"])
    assert all(x for family in ("GPL", "LGPL", "AGPL", "CC BY", "CC BY-SA", "CC BY-NC") for x in own[family] if family != "GPL")


@pytest.mark.parametrize("text", ["", "a", "\n\n\n", "word " * 50_000, "license\n" * 3000])
def test_odd_texts(spark, docs, text):
    df = spark.createDataFrame([(10_000, text)], "doc_id long, text string").unionByName(docs.where("doc_id < 5").select("doc_id", "text"))
    assert {r["doc_id"]: r["licences"] for r in licenses.scan(df).collect()}[10_000] == []
