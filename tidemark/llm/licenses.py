"""Licence scans by a trained paragraph classifier (operator 5). DataFrame functions and Spark ML only."""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut

# Notices by licence family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is distributed under the terms of the Apache License, version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Licensed under Apache 2.0.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Dual licensed under the GNU General Public License.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users.",
        "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU LGPL version 2.1 or later.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU AGPL version 3 or later.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["Licensed under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
}
# Lines about rights that name no family.
OTHERS = [
    "All rights reserved.", "Copyright by the authors and contributors.", "See the terms of use for details.", "You must be licensed to drive in this state.", "The software was released last year under a new name.",
    "A public licence hearing was held on the matter.", "This work is under review by the general public.", "Permission is granted to members of the club only.", "Free software is software that respects your freedom.", "The version of the file was changed without notice.",
]
# Short identifiers of licences by family, as files name them.
IDENTIFIERS = {
    "Apache": ["Apache-2.0"], "MIT": ["MIT"], "ISC": ["ISC"], "GPL": ["GPL-2.0-only", "GPL-3.0-or-later"], "LGPL": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-3-Clause"],
    "MPL": ["MPL-2.0"], "EPL": ["EPL-2.0"], "Unlicense": ["Unlicense"], "zlib": ["Zlib"], "CC BY": ["CC-BY-4.0"], "CC BY-SA": ["CC-BY-SA-4.0"], "CC BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"],
}
# Words that any text has; units are not looked for by these if a template has others.
PLAIN = set("a all an and any are as at be but by can for from have if in is it its may not of on or other see such than that the this to under we when which will with without you your 0".split())
UNKNOWN = "unknown"
#: Hashed features of words, and as many of word pairs.
FEATURES = 1 << 12
#: Documents, taken in order of a hash of their ids, whose paragraphs teach the class of unknown; the bound of what the fit reads.
SAMPLE_DOCS = 300
#: Partitions of the bounded training rows; each sends its gradient of all classes and features to the driver.
FIT_PARTS = 4
#: Variants of each template in training, and of each for calibration.
VARIANTS = 12
#: Part of a template's word pairs that a paragraph must have for the template to confirm a prediction.
CONFIRM = 0.6
#: Probability from which a family other than the likeliest is put to its templates too.
ALSO = 0.01
#: Part of the word pairs that a template shares with no other family which a paragraph must have too, so that siblings are told apart.
OWN = 0.5
#: Lines of the windows of a paragraph; each window overlaps the next by half.
WINDOWS = (4, 12, 40)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, digits as one mark."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+(\.[0-9]+)*", "0"), r"[^\p{L}0]+", " ")
    return F.split(F.trim(plain), " ")


def pairs(words: Column) -> Column:
    """Word pairs in order; a lone word counts as a pair. Neighbours are zipped, so the cost is linear in the words."""
    n = F.size(words)
    zipped = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, zipped).otherwise(words)


def rows_of(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(items)), f"array<struct<{schema}>>")))


def templates(spark: SparkSession) -> DataFrame:
    listed = [{"family": k, "text": x} for k, v in TEMPLATES.items() for x in [*v, *[f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS[k]]]]
    return rows_of(spark, listed, "family:string,text:string")


def variants(lines: DataFrame, seeds: range) -> DataFrame:
    """Each line as it is and with some words left out, by a hash of the word's place and the seed."""
    some = lines.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    words = F.split("text", " ")
    kept = F.filter(words, lambda w, i: (F.col("seed") == seeds[0]) | (F.pmod(F.xxhash64(w, i, F.col("seed")), F.lit(100)) >= 8))
    return some.select("family", F.array_join(kept, " ").alias("text"))


def sample_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines with a letter (text) of SAMPLE_DOCS documents: their ids are taken first, then the texts."""
    key = F.xxhash64(F.col("_i").cast("string"))
    ids = cut(docs.select(F.col(f"`{id_col}`").alias("_i")).orderBy(key, "_i").limit(SAMPLE_DOCS).distinct())
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    return texts.select(F.explode(F.split("_text", "\n")).alias("text")).where(F.col("text").rlike(r"\p{L}")).distinct()


def paragraphs(docs: DataFrame, id_col: str, text_col: str, wanted: list[str] | None = None) -> DataFrame:
    """Rows (id, row, block, words): the tokens of the lines of each text that have a letter, and of lines joined; of these, if there are ``wanted`` words, those that have one.

    A block is what stands between blank lines. Blocks of several lines are paragraphs too, joined whole or in
    overlapping windows of WINDOWS lines; so notices wrapped at any width, alone or amid other text, are seen.
    Tokens are made once, by line, before the rows are dealt out; joined lines are their lists joined.
    """
    text = F.col(f"`{text_col}`").cast("string")
    blocks = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(text, r"\n[ \t\r]*\n")).alias("block", "text"))
    blocks = blocks.select("id", "row", "block", F.transform(F.split("text", "\n"), tokens).alias("lines"))
    has = (lambda words: F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))) if wanted else (lambda words: F.exists(words, lambda w: w.rlike(r"\p{L}")))
    blocks = blocks.where(has(F.flatten("lines")))
    lines, n = F.col("lines"), F.size("lines")
    none = F.array().cast("array<array<string>>")
    joined = [F.when((n > size // 3) & (n <= size), F.array(F.flatten(lines))).when(n > size, F.transform(F.sequence(F.lit(1), n, F.lit(size // 2)), lambda at: F.flatten(F.slice(lines, at, size)))).otherwise(none) for size in WINDOWS]  # noqa: B023
    units = F.filter(F.concat(lines, F.when(n > 1, F.concat(*joined)).otherwise(none)), has)
    return blocks.select("id", "row", "block", F.explode(F.array_distinct(F.transform(units, lambda u: F.filter(u, lambda w: w != "")))).alias("words"))


def template_pairs(spark: SparkSession) -> DataFrame:
    """Rows (t_family, wanted, own): the distinct word pairs of each template, and those of them that no template of another family has."""
    listed = templates(spark).select("text", F.col("family").alias("t_family"), F.explode(F.array_distinct(pairs(tokens(F.col("text"))))).alias("pair"))
    lone = F.size(F.collect_set("t_family").over(Window.partitionBy("pair"))) == 1
    return listed.withColumn("lone", lone).groupBy("text", "t_family").agg(F.collect_list("pair").alias("wanted"), F.collect_list(F.when(F.col("lone"), F.col("pair"))).alias("own")).drop("text")


def telling_words(listed: list[list[str]]) -> list[str]:
    """Words of which every text that has CONFIRM of the pairs of one of the templates (``listed``) has at least one.

    Of each template words are taken until the pairs without one of them are too few to confirm it, those first that stand in the most pairs and are
    not PLAIN. So a paragraph without any of the words cannot be confirmed whatever a classifier says of it, and need not be put to one.
    """
    found: set[str] = set()
    for wanted in listed:
        left = [p.split(" ") for p in wanted]
        while True:
            left = [p for p in left if not found & set(p)]
            if len(left) < CONFIRM * len(wanted) or not left:
                break
            counts = Counter(w for p in left for w in set(p))
            found.add(min(counts, key=lambda w: (w in PLAIN, -counts[w], -len(w), w)))
    return sorted(found)


def without_notices(lines: DataFrame) -> DataFrame:
    """Distinct ``lines`` (text) less those that have 0.3 of a template's word pairs, found by an equi-join on the pairs."""
    wanted = cut(template_pairs(lines.sparkSession)).select(F.monotonically_increasing_id().alias("t"), F.size("wanted").alias("n"), F.explode("wanted").alias("pair"))
    lines = lines.select("text").distinct()
    own = lines.select("text", F.explode(F.array_distinct(pairs(tokens(F.col("text"))))).alias("pair"))
    near = own.join(F.broadcast(wanted), "pair").groupBy("text", "t", "n").count().where(F.col("count") >= 0.3 * F.col("n")).select("text")
    return lines.join(near.distinct(), "text", "left_anti")


def features() -> list:
    return [HashingTF(inputCol=x, outputCol=f"tf_{x}", numFeatures=FEATURES, binary=True) for x in ("words", "pairs")] + [VectorAssembler(inputCols=["tf_words", "tf_pairs"], outputCol="features")]


def with_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (with words) with their word pairs, none for a lone word."""
    return rows.withColumn("pairs", F.when(F.size("words") > 1, pairs(F.col("words"))).otherwise(F.array().cast("array<string>")))


def train(docs: DataFrame, id_col: str, text_col: str) -> tuple[PipelineModel, list[str], float]:
    """The model, its labels, and the probability of being a notice that calibration finds to be even.

    It learns from variants of the templates, lines of no family and the lines of a bounded sample of documents (those
    near a template left out). On other variants and the other half of the sample a logistic curve is laid through the
    log odds of being a notice (Platt's calibration, both classes of equal weight); the threshold is where it is one half.
    """
    spark = docs.sparkSession
    plain = without_notices(sample_lines(docs, id_col, text_col))
    plain = cut(plain.select(F.lit(UNKNOWN).alias("family"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")))
    others = rows_of(spark, [{"family": UNKNOWN, "text": x} for x in OTHERS], "family:string,text:string")

    def examples(seeds: range, half: int) -> DataFrame:
        parts = [variants(templates(spark), seeds), variants(others, seeds), plain.where(F.col("half") == half).select("family", "text")]
        return cut(with_pairs(reduce(DataFrame.unionByName, parts).withColumn("words", tokens(F.col("text")))).coalesce(FIT_PARTS))

    def weights(rows: DataFrame, name: str) -> DataFrame:
        share = rows.groupBy(name).count().agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("classes")).first()
        return rows.groupBy(F.col(name).alias("_class")).agg((share["all"] / share["classes"] / F.count(F.lit(1))).alias("weight"))

    taught = examples(range(VARIANTS), 0)
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc")
    fit = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.002, maxIter=60, family="multinomial", standardization=False)
    model = Pipeline(stages=[*features(), indexer, fit]).fit(taught.join(weights(taught, "family"), F.col("family") == F.col("_class")).drop("_class").coalesce(FIT_PARTS))
    labels = list(model.stages[-2].labels)
    model = PipelineModel([*model.stages[:-2], model.stages[-1].setRawPredictionCol("").setPredictionCol("")])
    held = score(model, labels, examples(range(100, 100 + VARIANTS), 1)).select((F.col("family") != UNKNOWN).cast("double").alias("notice"), F.log(F.greatest("p", F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9))).alias("odds"))
    held = cut(VectorAssembler(inputCols=["odds"], outputCol="odds_vector").transform(held))
    curve = LogisticRegression(featuresCol="odds_vector", labelCol="notice", weightCol="weight", regParam=0.001, maxIter=60).fit(held.join(weights(held, "notice"), F.col("notice") == F.col("_class")).coalesce(FIT_PARTS))
    even = -curve.intercept / curve.coefficients[0] if curve.coefficients[0] > 0 else 0.0
    return model, labels, 1 / (1 + math.exp(-even))


def score(model: PipelineModel, labels: list[str], rows: DataFrame) -> DataFrame:
    """``rows`` (with words and pairs) with the probability p of being a notice, and the families that may be named, array<struct<p, family>>: the
    likeliest, and others of ALSO and more."""
    p = vector_to_array("probability")
    each = F.array(*[F.struct(F.get(p, i).alias("p"), F.lit(x).alias("family")) for i, x in enumerate(labels) if x != UNKNOWN])
    scored = model.transform(rows).withColumn("p", 1 - F.get(p, labels.index(UNKNOWN)))
    some = scored.withColumn("each", each).withColumn("most", F.array_max("each")["p"])
    return some.withColumn("families", F.filter("each", lambda x: (x["p"] >= ALSO) | (x["p"] == F.col("most"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id of ``docs``: id, licences (array of families, sorted), n_notices (paragraphs between blank lines, by
    family named there), best_family, best_probability.

    A family counts if the probability that a paragraph is a notice reaches the calibrated threshold, the family is among the likely ones, and one of its templates
    has CONFIRM of its word pairs in the paragraph and OWN of those that no other family's templates have, which tell siblings apart. Other paragraphs are of
    the unknown class. Paragraphs of all whole texts that have a word without which no template can be confirmed (``telling_words``) are classified; for the others
    the answer is known. Nothing but ids and findings is shuffled.

    Nulls: a null text has no paragraphs; null ids are one row. Rows that share an id are scanned together.
    Extra columns are ignored; an empty table gives an empty result (nothing is trained).
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).distinct()
    if docs.isEmpty():
        none = ids.select(F.col("id").alias(id_col), F.array().cast("array<string>").alias("licences"), F.lit(0).cast("bigint").alias("n_notices"), F.lit(None).cast("string").alias("best_family"), F.lit(None).cast("double").alias("best_probability"))
        return none
    model, labels, threshold = train(docs, id_col, text_col)
    listed = cut(template_pairs(docs.sparkSession))  # some dozens of rows
    words = telling_words([r["wanted"] for r in listed.select("wanted").collect()])
    rows = with_pairs(paragraphs(docs, id_col, text_col, words))
    likely = score(model, labels, rows).where(F.col("p") >= threshold).select("id", "row", "block", F.explode("families").alias("f"), pairs(F.col("words")).alias("has")).select("id", "row", "block", "has", "f.p", F.col("f.family").alias("predicted"))
    by_family = listed.groupBy("t_family").agg(F.collect_list(F.struct("wanted", "own")).alias("templates"))
    part = lambda some: F.size(F.array_intersect(some, F.col("has")))
    confirmed = F.exists("templates", lambda t: (part(t["wanted"]) >= CONFIRM * F.size(t["wanted"])) & (part(t["own"]) >= OWN * F.size(t["own"])))
    found = likely.join(F.broadcast(by_family), F.col("predicted") == F.col("t_family")).where(confirmed)
    found = found.groupBy("id", "row", "block", "predicted").agg(F.max("p").alias("p"))
    found = found.groupBy("id").agg(F.array_sort(F.collect_set("predicted")).alias("licences"), F.count(F.lit(1)).alias("n_notices"), F.max(F.struct("p", "predicted")).alias("best"))
    out = ids.join(found.withColumnRenamed("id", "f_id"), F.col("id").eqNullSafe(F.col("f_id")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.col("best.predicted").alias("best_family"), F.col("best.p").alias("best_probability"))
