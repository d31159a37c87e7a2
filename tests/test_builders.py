"""Readers and writers of outside services, checked by the options they set; nothing connects."""

from retinue.sinks import messages
from retinue.sources import streams, tables
from pyspark.sql import functions as F


class Recorder:
    """Stands in for a session, reader or writer and notes what is asked of it."""

    def __init__(self, frame=None):
        self.seen, self.frame = {}, frame
        self.readStream = self.read = self.write = self

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, name, value):
        self.seen[name] = value
        return self

    def options(self, **more):
        self.seen.update(more)
        return self

    def load(self):
        return self.frame

    def save(self):
        self.seen["saved"] = True


def kafka_rows(spark):
    rows = [(bytearray(b"k"), bytearray("é".encode()), "t")]
    return spark.createDataFrame(rows, "key binary, value binary, topic string")


def test_kafka_streams(spark):
    session = Recorder(kafka_rows(spark))
    got = streams.text_stream(session, "host:1", ["a", "b"], startingOffsets="earliest")
    assert session.seen == {
        "format": "kafka", "kafka.bootstrap.servers": "host:1", "subscribe": "a,b", "startingOffsets": "earliest",
    }
    assert [r.value for r in got.collect()] == ["é"]
    images = streams.image_stream(session, "host:1", "image_topic", partitions=5)
    assert session.seen["subscribe"] == "image_topic" and images.rdd.getNumPartitions() == 5
    assert images.schema == streams.MESSAGE


def test_socket_stream():
    session = Recorder("lines")
    assert streams.socket_text_stream(session, "h", 7) == "lines"
    assert session.seen == {"format": "socket", "host": "h", "port": 7}


def test_jdbc_ranges():
    session = Recorder("rows")
    assert tables.read_jdbc(session, "jdbc:x", "info", "id", (0, 9), 3, user="u") == "rows"
    assert session.seen == {
        "format": "jdbc", "url": "jdbc:x", "dbtable": "info", "user": "u",
        "partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 3,
    }


def test_publish_to_kafka():
    writer = Recorder()
    messages.publish_kafka(writer, "host:1", "t")
    assert writer.seen == {"format": "kafka", "kafka.bootstrap.servers": "host:1", "topic": "t", "saved": True}


def test_lines_as_messages(spark):
    rows = messages.line_messages(spark.createDataFrame([("é b",)], "value string"))
    assert rows.schema == streams.MESSAGE
    assert rows.select(F.col("value").cast("string")).first()[0] == "é b"
