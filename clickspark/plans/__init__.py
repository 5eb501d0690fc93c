"""Named queries over the test tables (``registry``), their SQL oracle
(``oracle``) and the JSON reports (``reports``)."""
