import html
import random

from daybrook.llm import html_pages, html_text
from tests.llm.rows import sentence


def test_labelled_pages_held_out():
    model, wrong, total = html_text.train(), 0, 0
    for page in html_pages.labelled_pages(80, seed=77):
        nodes = html_pages.parse(page)
        chance = html_text.marginals(nodes, html_pages.features(nodes), model)
        for node, state, own in zip(nodes, html_pages.gold_states(nodes), chance, strict=True):
            if node.tag == "#text" and node.text:
                total += 1
                wrong += (own[1] >= 0.5) != (state == 1)
    assert total > 1000 and wrong / total < 0.02


def test_marginals_match_enumeration():
    from itertools import product
    from math import exp, prod
    nodes = html_pages.parse("<div class=ad>x</div><article><p>one two</p></article>")
    names, model = html_pages.features(nodes), html_text.train()
    score = html_text._potentials(names, nodes, model)
    total, chance = 0.0, [[0.0] * 3 for _ in nodes]
    for states in product(range(3), repeat=len(nodes)):
        weight = prod(score[k][s] for k, s in enumerate(states))
        weight *= prod(exp(model.pair[states[node.parent]][states[k]]) for k, node in enumerate(nodes) if node.parent >= 0)
        total += weight
        for k, s in enumerate(states):
            chance[k][s] += weight
    got = html_text.marginals(nodes, names, model)
    assert all(abs(got[k][s] - chance[k][s] / total) < 1e-9 for k in range(len(nodes)) for s in range(3))


def test_articles_come_out_whole(spark):
    pick, rows, want = random.Random(3), [], {}
    for i in range(40):
        blocks = [sentence(pick, pick.choice((1, 5, 40))) + pick.choice(("", ".", " & <x> é")) for _ in range(pick.randint(1, 8))]
        body = "".join(f"<p>{html.escape(b)}</p>" if pick.random() < 0.8 else f"<p><b>{html.escape(b)}<br>" for b in blocks)
        rows.append((i, "u", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a "
                             f"href=/a>menu</a></li><li><a href=/b>more</a></li></ul></nav><!-- ad --><div class=\"ad\">{sentence(pick, 9)}</div>"
                             f"<article>{body}</article><footer>&copy; x &middot; {sentence(pick, 6)}</footer>"))
        want[i] = "\n\n".join(blocks)
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<nav><a href=x>a</a></nav>"), (None, None, "<article><p>a&nbsp; b\n c&amp;d &lt;i&gt; &#233;&am</p></article>"),
             (103, "u", "<article><p>x</p><script>never closed"), (103, "u", "<article>one<br>two <i>three</i><p>4</p>five</article>"),
             (104, "u", "<article>" + "<p>word</p>" * 5000 + "</article>"), (105, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (106, "u", "plain < text & more")]
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "page_id LONG, url STRING, html STRING, text STRING, n_chars LONG")
    got = html_text.extract(table).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    for row in got:
        if row["page_id"] in want:
            assert row["text"] == want[row["page_id"]]
    by_id = [(r["page_id"], r["text"]) for r in got]
    assert (None, "a b c&d <i> é&am") in by_id and (100, "") in by_id and (101, "") in by_id and (102, "") in by_id
    assert (103, "one two three\n\n4\n\nfive") in by_id and (106, "plain < text & more") in by_id
    assert [text.count("word") for i, text in by_id if i == 104] == [5000]
    assert html_text.extract(table.limit(0)).collect() == []
