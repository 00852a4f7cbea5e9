"""Small text files beside tables, in whatever file system their path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that the driver reads and writes through Hadoop, so that it may be shared by a cluster."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(self.root.toUri(), self.conf)
        self.root = self.files.makeQualified(self.root)
        # Files of one line, replaced as a whole: sums beside them would only go stale.
        self.files.setVerifyChecksum(False)
        self.files.setWriteChecksum(False)
        self.files.mkdirs(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def name(self, name: str) -> str:
        return self.path(name).toString()

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def read(self, name: str) -> str:
        """The text of a file; bytes that are no UTF-8 become replacement characters."""
        stream = self.files.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Readers see the old text or the new one."""
        temporary = self.path(f"{name}.new")
        stream = self.files.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(temporary, self.path(name), how)

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)
