"""Line-network and trace analytics on Spark DataFrames."""
