"""noticeflow: announcement surveys and corpus preparation as Spark DataFrame plans."""
