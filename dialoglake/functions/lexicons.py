"""Default word lists, patterns and labels of the reference's domain. All are parameters of the operators."""

# Risk terms, first list that hits decides.
RISK = {
    "R2": ["自杀", "想死", "不想活了", "结束生命", "割腕", "跳楼", "吞药", "上吊", "煤气", "去死", "已经割", "已经吞", "已经吃了药", "现在就在楼顶", "准备跳", "准备割", "准备吞", "买好了药"],
    "R1": ["活着没意思", "没意义", "撑不住了", "扛不住了", "我崩溃了", "我快崩溃了", "想消失", "不如死了算了", "不想活", "想伤害自己", "自残", "反复想", "每天都想", "完全睡不着", "整夜睡不着"],
}

# Emotion terms, in order of precedence.
EMOTION = {
    "高兴/积极": ["开心", "高兴", "快乐", "满足", "充实", "成就感", "兴奋", "欣喜", "感恩"],
    "愤怒/生气": ["生气", "愤怒", "火大", "恼火", "讨厌", "气死", "烦死", "恨", "憎恨", "暴躁"],
    "焦虑/紧张": ["焦虑", "紧张", "压力", "担心", "害怕", "心慌", "恐慌", "慌", "失眠", "睡不着", "心跳", "惊恐"],
    "悲伤/消极": ["难过", "伤心", "低落", "抑郁", "绝望", "无助", "空虚", "没意义", "不想活", "活着没意思", "孤独", "丧"],
    "迷茫/困惑": ["迷茫", "困惑", "纠结", "犹豫", "不知所措", "不知道怎么办", "不知道该怎么办", "不知道怎么做", "没有方向", "找不到方向", "想不明白"],
}
NO_EMOTION = "中性/未知"

# Campus terms, and those that count twice.
CAMPUS = [
    "学校", "校园", "大学", "学院", "老师", "同学", "室友", "宿舍", "寝室", "宿管", "舍友", "班级", "课表", "课程", "选课", "补考", "重修", "期中", "期末", "考试", "挂科", "绩点", "GPA",
    "作业", "论文", "开题", "答辩", "实验课", "实验室", "课题组", "实习", "面试", "简历", "秋招", "春招", "校招", "考研", "保研", "推免", "导师", "助教", "辅导员", "班主任", "奖学金",
    "竞赛", "社团", "学生会", "图书馆", "自习室", "教室", "食堂", "校医院", "心理中心", "校心理", "宿舍楼", "军训", "学分", "选专业", "转专业", "双学位", "四六级", "英语", "学习", "课堂",
    "出勤", "点名",
]
CAMPUS_WEIGHTED = ["辅导员", "奖学金", "推免", "保研", "考研", "挂科", "绩点", "GPA", "校医院", "心理中心", "宿舍"]

# Hints of counselling talk, which daily chat must not have.
COUNSELLING = ["心理", "咨询", "倾诉", "抑郁", "焦虑", "自杀", "想死", "割腕", "跳楼", "吞药", "精神", "崩溃", "失眠", "恐慌", "创伤", "PTSD", "强迫", "双相"]

# Role labels of rendered text.
ROLE_LABELS = {"user": "[用户]", "assistant": "[助手]"}

# Acknowledgements, closing phrases, and the pattern of a request.
ACKS = ["嗯", "嗯嗯", "好", "好的", "行", "可以", "ok", "okay", "谢谢", "谢谢你", "多谢", "明白了", "了解了", "知道了", "懂了", "好吧", "行吧", "是的", "不是", "不", "别", "先这样"]
CLOSINGS = ["谢谢", "感谢", "多谢", "我会", "我明白", "我知道", "明白了", "了解了", "知道了", "懂了", "好的", "行吧", "好吧", "先这样", "再见", "拜拜"]
REQUEST = r"[？?]|怎么办|如何|怎么|为什么|能不能|可以吗|行吗|该不该|要不要|是否|有没有|能否|求|帮我|建议|方法"

# Topic buckets, in order of precedence.
TOPICS = {
    "crisis": ["想死", "自杀", "不想活", "轻生", "结束生命", "自残", "割腕", "跳楼", "吞药", "上吊"],
    "sleep": ["失眠", "睡不着", "熬夜", "噩梦", "睡眠"],
    "anxiety": ["焦虑", "恐慌", "紧张", "压力", "崩溃", "害怕"],
    "mood": ["难过", "不开心", "抑郁", "绝望", "哭", "心累", "无助"],
    "school": ["成绩", "考试", "期末", "作业", "课程", "选课", "绩点", "挂科", "复习", "论文", "答辩", "导师", "老师", "班主任", "辅导员", "学院", "实验室", "考研", "保研", "实习", "就业", "面试", "毕业", "奖学金", "处分"],
    "social": ["人际", "同学", "室友", "宿舍", "寝室", "朋友", "恋爱", "分手", "孤独", "被排挤"],
    "family": ["父母", "家庭", "家里", "吵架", "离婚", "家暴", "控制", "冷暴力"],
}
