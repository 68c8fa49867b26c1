import pytest

#: Extra columns whose names the operators use inside.
CLASH = "id long, size long, target string, start int, digest string, uid string, part int, block string, payload string, file string, row int, token string, did long, comp int, shared int, n long, taken int, epoch int, kind string, found string, owner string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
N_CLASH = len(CLASH.split(","))


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents, with clashing extra columns, from (doc_id, text, source) and perhaps lang."""

    def make(*rows):
        return spark.createDataFrame([(i, t, *(rest[1:] or ["en"]), (rest or [None])[0], None if t is None else len(t), *[None] * N_CLASH) for i, t, *rest in rows], SCHEMA)

    return make
