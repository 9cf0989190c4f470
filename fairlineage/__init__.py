"""Attribution of joined data to the parties who supplied it, as Spark jobs."""
