"""p2: refusals written without looking at any table, before the parts to learn from were tuned; none of them is a combination of those parts."""

import json
import random

from weftline.llm.answers import LABELS, facts, features, fit, flags, scores

HELD_OUT = """
Sorry, I'm going to sit this one out.
I can't share a view on that.
I'm not in a position to evaluate this statement.
That's not something I'm able to weigh in on.
I cannot fulfil this request.
I must respectfully decline.
As a large language model I don't hold opinions on such matters and can't rate it.
This is not a question I will answer.
I'm afraid I can't do that.
My instructions prevent me from grading this sentence.
I'd prefer to leave this unanswered because it touches on a sensitive subject.
Please understand that I cannot evaluate content involving real people.
Ich werde diese Aussage nicht bewerten.
Je ne répondrai pas à cette question.
No voy a evaluar esta frase.
""".strip().splitlines()
ANSWERS = """
The record of {} is complete and supports the year.
No source at hand mentions {}, so this stays open.
I cannot find {} in the evidence.
The second passage names another town than {}.
I do not know when {} was built.
It cannot be verified that {} was there.
""".strip().splitlines()
NAMES = ["Garwen", "Lusano", "Teldor", "Brinmor", "Quasel", "Denham"]


def test_held_out_refusals():
    rnd = random.Random(4)
    wrap = lambda t, p="UNKNOWN": json.dumps({"prediction": p, "confidence": 0.6, "rationale": t}, ensure_ascii=False)
    claims = [f"The {rnd.choice(['mill', 'tower'])} of {rnd.choice(NAMES)} was opened by the {rnd.choice(NAMES)} Council in {rnd.randint(1800, 1999)}." for _ in range(1500)]
    good = [f"The record for {rnd.choice(NAMES)} agrees with the date.", f"Evidence item 2 dates {rnd.choice(NAMES)} to another year.", "General knowledge supports the statement.", "The cited passage does not name the council."]
    sample = [(wrap(rnd.choice(good + ANSWERS).format(rnd.choice(NAMES)), p := rnd.choice(["FACTUAL", "NON_FACTUAL", "UNKNOWN"])), c, p) for c in claims]
    model = fit(sample)

    def refused(texts):
        f = facts(texts, claims[: len(texts)])
        return flags(f, scores(model.weights, model.bias, features(f, [None] * len(texts))), model.threshold)[:, LABELS.index("refusal")].mean()

    assert refused(HELD_OUT) >= 0.8 and refused([wrap(t) for t in HELD_OUT]) >= 0.8
    answers = [t.format(n) for t in ANSWERS for n in NAMES]
    assert refused(answers) <= 0.1 and refused([wrap(t) for t in answers]) <= 0.1
