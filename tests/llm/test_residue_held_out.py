"""p7: notices written from general knowledge, none of them an exemplar; most must be found, and texts about such things must not."""

from weftline.llm.residue import COVERED, EXEMPLARS, build_index, covered_words, exemplars, placeholders, words_of

HELD_OUT = """
HTTP error 404: the file or directory you requested was not found on the server.
Sorry, we could not find that page. The address may be wrong or the page may have been moved.
Error 404. It seems that the page you were looking for no longer exists.
Internal error. The server was unable to process your request. Please contact the site administrator.
503 error: our servers are temporarily unavailable due to maintenance. Please try again in a few minutes.
We'll be right back. The site is undergoing scheduled maintenance.
An unexpected error occurred while loading this page. Please try again.
Error 403: you are not authorized to access this resource.
You do not have access to this page. Please sign in with an authorized account.
Before you continue, please verify that you are not a robot by completing the captcha.
Too many requests from your IP address. Please wait and try again later.
Your access to this site has been blocked by the security service.
This page requires JavaScript. Please enable it in your browser settings and reload.
JavaScript must be enabled in your browser to use this application.
Please wait while the page is loading.
You are being redirected to another page. Click here if nothing happens.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
This is sample text. Replace it with your own content.
This section is under construction. Please check back soon.
Your headline here. Your description goes here.
Die angeforderte Seite wurde nicht gefunden oder wurde verschoben.
La page demandée n’existe pas ou a été supprimée.
La página solicitada no existe o ha sido eliminada.
Bitte JavaScript im Browser aktivieren, um die Seite zu nutzen.
""".strip().splitlines()
ARTICLES = """
The harbour of Garwen was rebuilt in 1931 after the storm had destroyed the eastern pier and most of the warehouses.
Engineers explain that a server answers with the number 404 when a page is missing, a convention that goes back to 1992 and the laboratory near Geneva.
The printer Lusano used lines of Latin as sample text long before computers, and scholars traced the passage to a treatise of Cicero.
In 1876 the council sent its surveyors to the valley, where they measured the river for nine years.
Museums in the region close on Mondays; the mill of Teldor can be visited from April to October.
""".strip().splitlines()


def test_held_out_notices():
    index = build_index(4000, {w: 800 for w in "the of and in to is was for by with a an you your this that on not are".split()})
    share = lambda t: covered_words(words_of(t), index).mean()
    missed = [t for t in HELD_OUT if share(t) < COVERED]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed
    assert not [t for t in ARTICLES if share(f"{t} {ARTICLES[3]}") >= COVERED or placeholders(t)]
    assert not {frozenset(words_of(t)) for t in HELD_OUT} & {frozenset(w) for _, w in exemplars()} and len(exemplars()) < 200 and len(EXEMPLARS) == 4


def test_harvested_from_error_pages(spark):
    from pyspark.sql import functions as F

    from weftline.llm.residue import harvest

    notice = "<html><body><a href='/'>Menu of the site</a><p>The shelf that held number %d is bare tonight.</p></body></html>"
    long = "<html><body><p>" + "The harbour of Garwen was rebuilt after the storm. " * 20 + "</p><p>Read the whole story of it.</p></body></html>"
    rows = [(k, 404, (notice % k).encode()) for k in range(3)] + [(2, 404, (notice % 2).encode())] + [(k, 500, long.encode()) for k in range(10, 14)]
    rows += [(k, 200, b"<p>One more such page of few words.</p>") for k in range(20, 24)] + [(30, 404, None), (31, 404, b""), (32, None, b"<p>x y z</p>")]
    df = spark.createDataFrame(rows, "id long, status int, body binary").withColumn("line", F.lit("x"))
    got = harvest(df, "id", "body", F.lit(None).cast("string"), df.status)
    assert got == ["the shelf that held number 9 is bare tonight"]
    assert harvest(df.limit(0), "id", "body", F.lit(None).cast("string"), df.status) == []
    words = words_of("The shelf that held number 77 is bare tonight.")
    index = build_index(100, {}, got)
    assert covered_words(words, index).all() and not covered_words(words, index, labels=False).any() and not covered_words(words, build_index(100, {})).any()
