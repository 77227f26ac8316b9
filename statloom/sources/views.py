"""Views derived from the base tables.

The base tables hold no statistics pages, task rows or economic prose, so these views render them
from the rows of the base tables: they grow with the tables. The same text runs in Spark and in the
checking engine. Every ``FROM`` ends its line, which lets :class:`Tables` bind the inputs.
"""

from __future__ import annotations

_OBS = """
SELECT CAST(p_partkey % 50 AS BIGINT) AS page_id,
       CAST(p_partkey AS BIGINT) AS o1,
       CASE p_partkey % 5 WHEN 0 THEN 'www.bct.gov.tn' WHEN 1 THEN 'www.ins.tn'
         WHEN 2 THEN 'www.finances.gov.tn' WHEN 3 THEN 'api.worldbank.org' ELSE 'news.example.org' END AS source_domain,
       CASE p_partkey % 4 WHEN 0 THEN 'html_table' WHEN 1 THEN 'clean_table' WHEN 2 THEN 'pattern_modern' ELSE 'json_generic' END AS method,
       concat(CASE p_partkey % 12 WHEN 0 THEN 'Taux directeur' WHEN 1 THEN 'Inflation' WHEN 2 THEN 'PIB par habitant'
         WHEN 3 THEN 'Population totale' WHEN 4 THEN 'Exportations de biens' WHEN 5 THEN 'Dette publique'
         WHEN 6 THEN 'Tableau' WHEN 7 THEN '<b>Budget</b>' WHEN 8 THEN 'GDP Tunisia' WHEN 9 THEN 'x'
         WHEN 10 THEN 'Source: note' ELSE p_name END,
         CASE WHEN p_partkey % 3 = 0 THEN concat(' ', CAST(2014 + p_partkey % 14 AS STRING)) ELSE '' END) AS indicator_name,
       CASE p_partkey % 6
         WHEN 0 THEN concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), ',5')
         WHEN 1 THEN concat('1.', lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING), 3, '0'), ',25 %')
         WHEN 2 THEN concat('1,', lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING), 3, '0'), '.75 MD')
         WHEN 3 THEN CAST(2000 + p_partkey % 40 AS STRING)
         WHEN 4 THEN 'n/d' ELSE concat('-', CAST(p_size AS STRING), '.0 usd') END AS value_text,
       p_retailprice AS value,
       CASE p_partkey % 7 WHEN 0 THEN '%' WHEN 1 THEN 'pourcent' WHEN 2 THEN 'millions de dinars' WHEN 3 THEN 'USD' WHEN 4 THEN 'habitants' ELSE '' END AS unit,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(2006 + p_partkey % 27 AS INT) END AS year,
       CAST((p_partkey * 37 % 101) AS DOUBLE) / 100 AS confidence_score
FROM part
"""

_HTML = """
SELECT CAST(p_partkey AS BIGINT) AS page_id,
       CASE p_partkey % 3 WHEN 0 THEN 'https://www.bct.gov.tn/tableau.jsp' WHEN 1 THEN 'https://www.ins.tn/statistiques/50' ELSE 'https://news.example.org/a' END AS url,
       concat('<html><head><title>', p_name, '</title><script>url: "/data/', CAST(p_partkey AS STRING), '.json"</script></head><body>',
         '<table class="data-table"><tr><th>Indicateur</th><th>', CAST(2016 + p_size % 12 AS STRING), '</th><th>2023</th></tr>',
         '<tr><td>Taux ', p_brand, '</td><td>', CAST(p_size AS STRING), ',5 %</td><td>', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '</td></tr>',
         '<tr><td>Tableau</td><td>1</td><td>2</td></tr></table>',
         '<ul class="stat"><li>Inflation: ', CAST(p_size % 9 AS STRING), ',', CAST(p_size % 10 AS STRING), ' %</li><li>Population - ', CAST(p_size AS STRING), ' millions 2021</li></ul>',
         '<p>PIB: ', CAST(p_size AS STRING), '.2 milliards</p><pre>', chr(10), 'Emploi | ', CAST(p_size AS STRING), ' | 7,5', chr(10), '</pre>',
         '<form action="/q" method="post"><input type="hidden" name="k" value="', CAST(p_partkey AS STRING), '"></form></body></html>') AS html
FROM part
"""

_MESSY_PAGES = """
SELECT CAST(p_partkey AS BIGINT) AS page_id, concat('https://www.ins.tn/brut/', CAST(p_partkey AS STRING)) AS url,
       concat('<div class="main-menu"><div>Menu ', p_brand, '</div><ul><li>Taux 1</ul></div><NAV><nav>x</nav>y</NAV>Page ', CAST(p_partkey AS STRING),
         '<!-- <table><tr><td>Taux caché</td><td>1</td></tr></table> --><table class=data><tr><td>Taux ', p_brand, '<td title="a>b">', CAST(p_size AS STRING), ',5 %</tr>',
         '<tr><td><table><tr><td>Dette ', p_brand, '</td><td>', CAST(p_size AS STRING), '</td></tr></table></td><td>9</td></tr></table></td></tr>',
         '<form action=/q?a=1 METHOD=post><div><input name=k value=', CAST(p_partkey AS STRING), '><input type=submit name=go></div></form><script>var t = "</p>"; <ul') AS html
FROM part
"""

_API_JSON = """
SELECT CAST(o_custkey % 25 AS BIGINT) AS page_id, CAST(o_orderkey AS BIGINT) AS o1,
       concat('[{"page":1,"total":2},[{"indicator":{"id":"NY.GDP","value":"GDP"},"country":{"id":"TN","value":"Tunisia"},"date":"',
         CAST(2012 + o_orderkey % 15 AS STRING), '","value":', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING),
         '},{"indicator":{"id":"NY.GDP","value":"GDP"},"country":{"id":"TN","value":"Tunisia"},"date":"2020","value":null}]]') AS content
FROM orders
"""

_MIXED_PAGES = """
SELECT CAST(5000000000 + o1 AS BIGINT) AS page_id, concat('https://api.worldbank.org/v2/country/TN/', CAST(o1 AS STRING)) AS url, content AS html
FROM api_json
UNION ALL
SELECT CAST(6000000000 + p_partkey AS BIGINT) AS page_id, concat('https://api.example.org/v2/name/', CAST(p_partkey AS STRING)) AS url,
       concat('{"population":', CAST(p_size * 1000 AS STRING), ',"active":true,"area":', CAST(p_size AS STRING), '.5,"year":2020,"name":"', p_name, '","deep":{"density":7}}') AS html
FROM part
UNION ALL
SELECT CAST(8000000000 + p_partkey AS BIGINT) AS page_id, concat('https://news.example.org/o/', CAST(p_partkey AS STRING)) AS url,
       concat('{"deep":[{"a":{"taux":', CAST(p_size AS STRING), ',"code":5}}],"ok":true}') AS html
FROM part
UNION ALL
SELECT CAST(7000000000 + p_partkey AS BIGINT) AS page_id, concat('https://news.example.org/t/', CAST(p_partkey AS STRING)) AS url,
       concat('<table><tr><td>Taux ', p_brand, '</td><td>', CAST(p_size AS STRING), ',5 %</td></tr></table>') AS html
FROM part
"""

_TASKS = """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('t', CAST(o_orderkey AS STRING)) END AS task_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
       CAST(o_orderkey % 12 AS INT) AS priority,
       concat('https://h', CAST(o_custkey % 9 AS STRING), '.example.org/p/', CAST(o_orderkey AS STRING), '?s=1#f') AS url,
       CAST(o_custkey % 14 AS INT) AS n_urls,
       CASE o_orderkey % 6 WHEN 0 THEN '3/5' WHEN 1 THEN '4' WHEN 2 THEN '2.0' WHEN 3 THEN 'bad' WHEN 4 THEN '-1' ELSE NULL END AS progress_current,
       CASE o_orderkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '0' WHEN 2 THEN '3' ELSE NULL END AS progress_total,
       CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE '{"execution_time": 2.5}' END AS metrics,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_orderdate + INTERVAL '90' SECOND ELSE NULL END AS completed_at,
       CAST(o_orderkey AS BIGINT) AS row_id
FROM orders
"""

_RESULTS = """
SELECT concat('t', CAST(l_orderkey AS STRING)) AS task_id, CAST(l_linenumber AS INT) AS ordinal,
       concat('https://h', CAST(l_suppkey AS STRING), '.example.org/', CAST(l_partkey AS STRING)) AS url,
       l_returnflag <> 'R' AS success,
       CASE l_linestatus WHEN 'O' THEN 'traditional' ELSE 'intelligent' END AS strategy_used,
       l_discount * 10 AS confidence_score, CAST(l_quantity AS INT) AS extraction_count,
       l_tax * 100 AS processing_time
FROM lineitem
"""

_URLS = """
SELECT CAST(page_id AS BIGINT) AS url_id, url
FROM pages
UNION ALL
SELECT CAST(1000000000 + p_partkey AS BIGINT) AS url_id,
       CASE p_partkey % 16
         WHEN 0 THEN concat('https://www.bct.gov.tn/siteprod/page', CAST(p_partkey AS STRING), '.jsp')
         WHEN 1 THEN concat('https://www.ins.tn/statistiques/', CAST(p_partkey AS STRING), '?lang=fr#top')
         WHEN 2 THEN concat('https://www.finances.gov.tn/fr/rapport-', CAST(p_partkey AS STRING), '.xlsx')
         WHEN 3 THEN concat('https://api.worldbank.org/v2/', CAST(p_partkey AS STRING), '?format=json')
         WHEN 4 THEN concat('http://X.org/docs/', CAST(p_partkey AS STRING), '.PDF')
         WHEN 5 THEN concat('ftp://files.example.org/', CAST(p_partkey AS STRING))
         WHEN 6 THEN concat('  https://www.tunisieindustrie.nat.tn/', CAST(p_partkey AS STRING), ' ')
         WHEN 7 THEN concat('https://restcountries.com/v3.1/name/', CAST(p_partkey AS STRING))
         WHEN 8 THEN concat('https://www.commerce.gov.tn:8443/index.php?id=', CAST(p_partkey AS STRING))
         WHEN 9 THEN concat('https://shop.business.example/', CAST(p_partkey AS STRING), '#tableau')
         WHEN 10 THEN concat('http:///nohost/', CAST(p_partkey AS STRING))
         WHEN 11 THEN concat('https://opendata.example.org/export?format=csv&id=', CAST(p_partkey AS STRING))
         WHEN 12 THEN concat('https://data.imf.org/actualites/', CAST(p_partkey AS STRING), ';v=1?x=1#f')
         WHEN 13 THEN concat('postgresql://loader:pw', CAST(p_partkey AS STRING), '@db:5432/store')
         WHEN 14 THEN ''
         ELSE concat('https://www.douane.gov.tn/publication/', CAST(p_partkey AS STRING), '.json') END AS url
FROM part
"""

_NOTES = """
SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source
FROM documents
UNION ALL
SELECT CAST(1000000000 + p_partkey AS BIGINT) AS doc_id,
       CASE p_partkey % 10
         WHEN 0 THEN concat('PIB: ', CAST(p_size AS STRING), '.2 milliards en ', CAST(2014 + p_partkey % 14 AS STRING), '. Inflation: ', CAST(p_size % 9 AS STRING), ',3 %. Taux de chômage: 15,1 %. Source: INS, enquête 2022.')
         WHEN 1 THEN concat('La Banque Centrale de Tunisie (BCT) maintient le taux directeur à ', CAST(p_size % 9 AS STRING), '.5 % for ', CAST(2015 + p_partkey % 11 AS STRING), '. Masse monétaire et réserves en dinar. Crédit: ', CAST(p_size * 31 AS STRING), ' MD.')
         WHEN 2 THEN concat('Statistics Tunisia ', CAST(2012 + p_partkey % 16 AS STRING), ': population ', CAST(p_size AS STRING), ' millions habitants, natalité et mortalité. Recensement INS. Tunis, Sfax et Sousse. Janvier 2021, mars 2021, 2022.')
         WHEN 3 THEN concat('Industrie et production: capacité ', CAST(p_size AS STRING), '%; exportation ', CAST(p_size * 17 AS STRING), ',5 millions de dinars en ', CAST(2016 + p_partkey % 9 AS STRING), '. Tableau 1. Tableau 2. Secteur manufacturier, usine ', p_name, '.')
         WHEN 4 THEN concat('Exportations: ', CAST(p_size * 11 AS STRING), ' milliards. Importations: ', CAST(p_size * 13 AS STRING), ' md. Balance commerciale et partenaires, commerce extérieur ', CAST(2017 + p_partkey % 8 AS STRING), '. Data report.')
         WHEN 5 THEN concat('Emploi, salaires et protection sociale. Taux chômage ', CAST(p_size % 20 AS STRING), '.4 %. Ministère des Finances, gouvernement tunisien. Méthodologie: enquête, sondage. Document officiel ', CAST(2018 + p_partkey % 9 AS STRING), '.')
         WHEN 6 THEN concat('GDP current US 2', lpad(CAST(p_size AS STRING), 3, '0'), ' data. Year: ', CAST(2010 + p_partkey % 20 AS STRING), chr(10), 'unemployment rate ', CAST(p_size % 30 AS STRING), ',7 % growth and trade balance 1 234 567.')
         WHEN 7 THEN ''
         WHEN 8 THEN concat('Taux directeur: ', CAST(p_size % 9 AS STRING), ',5 %; réserves 21 4', lpad(CAST(p_size AS STRING), 2, '0'), ' md; Euro: 3,', CAST(p_size AS STRING), '; Budget: 1 2', lpad(CAST(p_size AS STRING), 2, '0'), ',5 millions; dette ', CAST(p_size + 60 AS STRING), ',2 md; investissement: ', CAST(p_size AS STRING), '.')
         ELSE concat('Note ', p_name, ' ', CAST(p_retailprice AS STRING), ' USD; ', repeat('mot sans valeur. ', CAST(p_size AS INT)), 'Fin 2020.') END AS text,
       CASE p_partkey % 4 WHEN 0 THEN 'bct.gov.tn' WHEN 1 THEN 'www.ins.tn' WHEN 2 THEN 'commerce.example' ELSE 'src' END AS source
FROM part
"""

_SITES = """
SELECT CAST(page_id AS BIGINT) AS page_id, url, html
FROM pages
UNION ALL
SELECT CAST(1000000000 + page_id AS BIGINT) AS page_id, url, html
FROM html
"""

_NOTE_PAGES = """
SELECT doc_id AS page_id,
       CASE doc_id % 3 WHEN 0 THEN concat('https://www.bct.gov.tn/n/', CAST(doc_id AS STRING))
         WHEN 1 THEN concat('https://www.ins.tn/n/', CAST(doc_id AS STRING)) ELSE concat('https://www.finances.gov.tn/n/', CAST(doc_id AS STRING)) END AS url,
       concat('<html><body><div class="info">', text, '</div></body></html>') AS html
FROM notes
"""

_FIELD_PAGES = """
SELECT CAST(3000000000 + page_id AS BIGINT) AS page_id, url, html
FROM html
UNION ALL
SELECT page_id, url, html
FROM note_pages
"""

_LINK_PAGES = """
SELECT CAST(p_partkey AS BIGINT) AS page_id,
       concat('https://s', CAST(p_partkey % 40 AS STRING), '.example.org/n/', CAST(p_partkey AS STRING)) AS url,
       concat('<html><body><a href="/n/', CAST(p_partkey + 40 AS STRING), '">next</a>',
         '<a href="/n/', CAST(p_partkey + 80 AS STRING), '">after</a>',
         '<a href="https://s', CAST(p_partkey % 40 AS STRING), '.example.org/statistique/', CAST(p_size AS STRING), '">stat</a>',
         '<a href="#top">top</a><a href="/contact">contact</a><a href="https://other.example.net/x">out</a>',
         '<a href="/n/', CAST(p_partkey AS STRING), '.zip">zip</a><a href="/q?a=1&b=2&c=3&d=4&e=5">many</a>',
         '<a href="page-', CAST(p_partkey % 7 AS STRING), '">relative</a></body></html>') AS html
FROM part
"""

_DUMPS = """
SELECT CAST(p_partkey AS BIGINT) AS dump_id,
       concat('{"task_id":"t', CAST(p_partkey AS STRING), '","status":"', CASE WHEN p_partkey % 5 = 0 THEN 'failed' ELSE 'completed' END,
         '","results":[{"url":"https://www.ins.tn/', CAST(p_partkey AS STRING), '","content":{"structured_data":{',
         '"target_indicators":{"a":{"indicator_name":"Inflation ', p_brand, '","value":', CAST(p_size AS STRING), '.5,"unit":"pourcentage","category":"prix_et_inflation","confidence":0.9,"is_priority_indicator":', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, '},',
         '"b":{"indicator_name":"PIB par habitant","value":', CAST(p_size * 3 AS STRING), ',"unit":"md tnd","category":"', CASE WHEN p_partkey % 3 = 0 THEN 'autre' ELSE 'comptes_nationaux' END, '","confidence":0.4}},',
         '"key_figures":{"Balance commerciale":{"value":', CAST(p_size * 7 AS STRING), ',"unit":"USD"},"note":{"text":"x"}},',
         '"tables_data":[{"rows":[{"indicator_name":"Epargne nationale","c1":{"value":', CAST(p_size AS STRING), ',"unit":"milliers"},"c2":{"value":2}}]},{"rows":[]}],',
         '"extracted_values":{"table_0_1_', CAST(p_size AS STRING), '":{"value":', CAST(p_retailprice AS STRING), ',"indicator_name":"', p_name, '","unit":"","year":2021,"confidence_score":0.8},',
         '"wb_2020_0":{"value":', CAST(p_size AS STRING), ',"indicator_name":"GDP Tunisia 2020","unit":"USD","year":2020,"confidence_score":0.95}}}}}],',
         '"meta":{"extracted_values":{"k":{"value":1}},"id":7,"count":', CAST(p_size AS STRING), ',"list":[1,2,{"code":3,"depth":{"level":', CAST(p_size % 5 AS STRING), '}}]}}') AS content
FROM part
"""

_REPLIES = """
SELECT CAST(p_partkey AS BIGINT) AS reply_id,
       CASE p_partkey % 6
         WHEN 0 THEN concat('```json', chr(10), '{"indicateurs": ["PIB", "inflation", "', p_name, '"], "annees": [2024, 2016, ', CAST(2010 + p_partkey % 18 AS STRING), '], "qualite": "bon", "confiance": 1.8}', chr(10), '```')
         WHEN 1 THEN concat('Voici: {"indicators": "', p_brand, '", "years": [2019], "confidence": 0.', CAST(p_size % 10 AS STRING), '} fin')
         WHEN 2 THEN concat('```', chr(10), '{"metric_list": ["a","b","c","d","e","f","g","h","i","j","k","', p_name, '"]}', chr(10), '```')
         WHEN 3 THEN concat('pas de json, mais inflation et taux ', CAST(p_size AS STRING), ' en 2021')
         WHEN 4 THEN concat('{"quality": "ok', CAST(p_size AS STRING), '", "conf": -2}')
         ELSE '' END AS response
FROM part
"""

_TASK_URL = """CASE (row_id + ordinal) % 7 WHEN 0 THEN '' WHEN 1 THEN concat('https://h', CAST(ordinal AS STRING), '.example.org/p')
         WHEN 2 THEN 'https://api.example.org/v1' WHEN 3 THEN 'https://www.ins.tn/x' ELSE url END AS url"""

_TASK_URLS = f"""
SELECT row_id, task_id, CAST(ordinal AS INT) AS ordinal, {_TASK_URL}
FROM (SELECT row_id, task_id, url, unnest(generate_series(1, n_urls)) AS ordinal FROM tasks
) listed
"""

_TASK_URLS_SPARK = f"""
SELECT row_id, task_id, ordinal, {_TASK_URL}
FROM (SELECT row_id, task_id, url, explode(sequence(1, n_urls)) AS ordinal FROM tasks
WHERE n_urls > 0) listed
"""

VIEWS: dict[str, str] = {
    "obs": _OBS,
    "html": _HTML,
    "messy_pages": _MESSY_PAGES,
    "api_json": _API_JSON,
    "mixed_pages": _MIXED_PAGES,
    "tasks": _TASKS,
    "results": _RESULTS,
    "urls": _URLS,
    "notes": _NOTES,
    "sites": _SITES,
    "note_pages": _NOTE_PAGES,
    "field_pages": _FIELD_PAGES,
    "link_pages": _LINK_PAGES,
    "dumps": _DUMPS,
    "replies": _REPLIES,
    "task_urls": _TASK_URLS,
}

# Same rows, but the two engines spell the list expansion differently.
SPARK_VIEWS: dict[str, str] = {"task_urls": _TASK_URLS_SPARK}

BASES: dict[str, tuple[str, ...]] = {
    "obs": ("part",),
    "html": ("part",),
    "messy_pages": ("part",),
    "api_json": ("orders",),
    "mixed_pages": ("api_json", "part"),
    "tasks": ("orders",),
    "results": ("lineitem",),
    "urls": ("pages", "part"),
    "notes": ("documents", "part"),
    "sites": ("pages", "html"),
    "note_pages": ("notes",),
    "field_pages": ("html", "note_pages"),
    "link_pages": ("part",),
    "dumps": ("part",),
    "replies": ("part",),
    "task_urls": ("tasks",),
}


def view_dependencies(name: str) -> tuple[str, ...]:
    """Views that must be defined before ``name``, in order."""
    out: list[str] = []
    for base in BASES[name]:
        if base in VIEWS:
            out.extend((*view_dependencies(base), base))
    return tuple(out)
