"""DDL and data changes through the front door."""

import pytest

from tidewheel.operators.dml import ConstraintError
from tidewheel.plans.engine import Engine


def test_tables_and_constraints(spark):
    e = Engine(spark)
    rows = lambda q: sorted(map(tuple, e.sql(q).collect()))
    e.sql("CREATE TABLE p (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(20) NOT NULL DEFAULT 'none', n INT, twice INT AS (n * 2) STORED, CHECK (n < 100))")
    e.sql("INSERT INTO p (name, n) VALUES ('a', 1), ('b, c', 2)")
    e.sql("INSERT INTO p (n) VALUES (3)")
    assert rows("SELECT * FROM p") == [(1, "a", 1, 2), (2, "b, c", 2, 4), (3, "none", 3, 6)]
    assert e.last_insert_id == 3
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO p (id, n) VALUES (1, 5)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO p (n) VALUES (500)")
    e.sql("INSERT INTO p (id, n) VALUES (1, 5) ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    assert rows("SELECT id, n FROM p WHERE id = 1") == [(1, 6)]
    assert e.sql("UPDATE p SET n = 0 WHERE id > 1").first()[0] == 2
    assert rows("SELECT id, n, twice FROM p")[1:] == [(2, 0, 0), (3, 0, 0)]
    e.sql("CREATE TABLE c (k INT, p_id INT, FOREIGN KEY (p_id) REFERENCES p (id) ON DELETE CASCADE)")
    e.sql("INSERT INTO c VALUES (1, 2), (2, 3), (3, NULL)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO c VALUES (9, 77)")
    with pytest.raises(ConstraintError):
        e.sql("DROP TABLE p")
    assert e.sql("DELETE FROM p WHERE id = 2").first()[0] == 1
    assert rows("SELECT k FROM c") == [(2,), (3,)]
    e.sql("ALTER TABLE c ADD COLUMN note VARCHAR(5) DEFAULT 'x', RENAME COLUMN k TO kk")
    assert rows("SELECT kk, note FROM c") == [(2, "x"), (3, "x")]
    e.sql("REPLACE INTO p (id, name, n) VALUES (3, 'new', 9)")
    assert rows("SELECT name FROM p WHERE id = 3") == [("new",)]
    e.sql("CREATE TABLE q AS SELECT id FROM p")
    e.sql("TRUNCATE TABLE q")
    assert rows("SELECT count(*) FROM q") == [(0,)]
    with pytest.raises(ConstraintError):
        e.sql("ALTER TABLE p ADD CONSTRAINT big CHECK (n > 100)")
