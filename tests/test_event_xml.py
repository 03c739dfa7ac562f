"""Event XML of several forms, and how often it is read."""

from __future__ import annotations

import re

from graphwright.sources import structured


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_event_xml_is_read_twice_at_most(spark):
    head = '<Event xmlns="urn:e"><System><Provider Name="A"/><EventID>7</EventID><TimeCreated SystemTime="2024-01-02T03:04:05Z"/><EventRecordID>9</EventRecordID><Computer> c </Computer></System><EventData>'
    datas = ['<Data Name="x">1</Data><Data Name="e"/><Data Name="y"> b &amp; c </Data>', "", "<Data/>", '<Data Name="x"><![CDATA[<q>]]></Data>', '<Data Name="x">1</Data><Data>', None]
    rows = [(i, None if d is None else (head + d + ("</Data>" if d.endswith("<Data>") else "") + "</EventData></Event>")) for i, d in enumerate(datas)]
    df = structured.event_records(spark.createDataFrame(rows, "id int, xml string"))
    got = {r.id: r for r in df.collect()}
    assert [got[i].data for i in range(6)] == [{"x": "1", "y": " b & c "}, {}, {}, {"x": "<q>"}, {"x": "1"}, None]
    assert (got[0].provider, got[0].event_id, got[0].computer, got[0].record_number, got[0].channel) == ("A", 7, " c ", 9, None)
    assert got[5].provider is None and got[5].instant is None
    # once for the single values, once for the data, and data of another form by two paths
    plan = plan_of(df)
    assert len(re.findall("xpath", plan, re.I)) <= 4


def test_data_of_another_form_keeps_its_order(spark):
    """Names and texts that do not take turns are matched as lists, as before."""
    xml = '<Event><EventData><Data Name="x">1</Data><Data><!-- c --></Data><Data Name="y">2<b/></Data></EventData></Event>'
    row = structured.event_records(spark.createDataFrame([(xml,)], "xml string")).first()
    assert row.data == {"x": "1", "y": "2"}
