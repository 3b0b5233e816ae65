"""Where language models are fitted."""

import os

from densigrid.llm import langid


def test_the_driver_does_not_fit_the_model(spark, monkeypatch):
    driver, fit = os.getpid(), langid.fit

    def elsewhere(samples):
        assert os.getpid() != driver
        return fit(samples)

    monkeypatch.setattr(langid, "fit", elsewhere)
    rows = [(i, ("ababab cab " if i % 2 else "xyxyx zyx ") * (3 + i % 5), "one" if i % 2 else "two") for i in range(80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["one", "two"] and langid.decide(model, "abab cab")[0] == "one"
